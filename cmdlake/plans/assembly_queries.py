"""Queries that put datasets together, review them and compare models, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cmdlake.functions.text import dedup_key
from cmdlake.operators import assembly, bootstrap, datasets, splits
from cmdlake.plans.behaviour_queries import _STRENGTH
from cmdlake.plans.dataset_queries import KEY, docs
from cmdlake.plans.triage_queries import RULED, ruled
from cmdlake.sources.gallery import ADMIN_SQL, GALLERY_SQL, gallery

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def digest(salt: str, column: str = "doc_id"):
    return F.sha2(F.concat(F.lit(salt + ":"), F.col(column).cast("string")), 256)


def hashed(salt: str, column: str = "doc_id") -> str:
    return f"sha256('{salt}:' || CAST({column} AS VARCHAR))"


@query(f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {hashed('w4')}) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN (r - 1) / n < 0.8 THEN 'train' WHEN (r - 1) / n < 0.9 THEN 'validation' ELSE 'test' END AS split FROM r")
def win4_shuffled_split(spark, sf_dir):
    return assembly.shuffled_split(docs(spark, sf_dir).select("doc_id"), digest("w4")).select("doc_id", "split")


_MISSING = {"en": 7, "de": 3}


@query(
    f"WITH rows_ AS (SELECT DISTINCT sha256({KEY}) AS key FROM benchmark), res AS (SELECT sha256({KEY}) AS key, arg_min(doc_id, {hashed('top')}) AS doc_id, arg_min(lang, {hashed('top')}) AS lang FROM documents GROUP BY 1), "
    f"r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {hashed('top')}) AS r FROM res ANTI JOIN rows_ USING (key) WHERE lang IN ('en', 'de')) SELECT doc_id, lang FROM r WHERE r <= CASE lang WHEN 'en' THEN 7 ELSE 3 END"
)
def dst4_top_up(spark, sf_dir):
    key = F.sha2(dedup_key(F.col("text")), 256).alias("key")
    reserve = docs(spark, sf_dir).select(key, "doc_id", "lang")
    return assembly.topped_up(docs(spark, sf_dir, "benchmark").select(key), reserve, "key", "lang", _MISSING, digest("top")).select("doc_id", "lang")


_POOLS = {"ip": ["10.1.1.1", "10.2.2.2", "10.3.3.3"], "account": ["ann@a.example", "bob@b.example"], "tmp": ["/tmp/one", "/tmp/two"], "port": [":81", ":8081"]}


def _drawn(text: str) -> str:
    for name, pattern in assembly.SLOTS:
        pool = _POOLS[name]
        d = f"CAST(('0x' || sha256(event_id || ':' || copy || ':{name}')[1:8]) AS BIGINT)"
        text = f"CASE WHEN {d} / 4294967296.0 < 0.7 THEN regexp_replace({text}, '{pattern}', {pool!r}[1 + {d} % {len(pool)}], 'g') ELSE {text} END"
    return text


@query(f"WITH g AS (SELECT event_id, command, unnest([1, 2, 3]) AS copy FROM ({GALLERY_SQL})) SELECT event_id, copy, {_drawn('command')} AS command FROM g")
def dst5_varied_commands(spark, sf_dir):
    return assembly.varied(gallery(spark, sf_dir), "event_id", "command", _POOLS, 3)


@query(
    f"WITH o AS (SELECT sha256({KEY}) AS key, arg_min(doc_id, (lang, doc_id)) AS doc_id, min(lang) AS lang FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('q:' || key)) AS r FROM o), "
    "w AS (SELECT *, r <= CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 10 ELSE 0 END AS own FROM r), a AS (SELECT *, row_number() OVER (ORDER BY own DESC, sha256('q:' || key)) AS n FROM w) SELECT doc_id, lang, CASE WHEN own THEN 'quota' ELSE 'fill' END AS chosen FROM a WHERE n <= 40"
)
def dst8_quota_assembly(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.sha2(dedup_key(F.col("text")), 256).alias("key"), F.struct("lang", "doc_id").alias("bucket"))
    once = rows.groupBy("key").agg(F.min("bucket").alias("b")).select("key", "b.*")
    return assembly.by_quota(once, "key", "lang", {"en": 5, "de": 10}, 40, F.sha2(F.concat(F.lit("q:"), "key"), 256)).select("doc_id", "lang", "chosen")


def _has(parts) -> str:
    return "(" + " OR ".join(f"contains(lower(command), '{p}')" for p in parts) + ")"


_FAMILY = "CASE " + " ".join(f"WHEN {' AND '.join(_has(g) for g in groups)} THEN '{name}'" for name, groups in assembly.THREATS) + " END"


@query(f"WITH g AS (SELECT event_id, command FROM ({GALLERY_SQL}) UNION ALL SELECT event_id + 1000000000, command FROM ({ADMIN_SQL})) SELECT event_id, {_FAMILY} AS family FROM g")
def dst9_threat_family(spark, sf_dir):
    both = gallery(spark, sf_dir).select("event_id", "command").unionByName(gallery(spark, sf_dir, ADMIN_SQL).select((F.col("event_id") + 1000000000).alias("event_id"), "command"))
    return both.select("event_id", assembly.threat_family(F.col("command")).alias("family"))


_REVIEW = ", ".join(f"CASE WHEN {_has(parts)} THEN '{name}' END" for name, parts in assembly.RUBRIC)


@query(
    f"WITH g AS (SELECT event_id, command FROM ({ADMIN_SQL})), r AS (SELECT *, list_filter([{_REVIEW}], lambda b: b IS NOT NULL) AS b, {_has(assembly.PLAIN)} AND NOT {_has(assembly.DOUBTFUL)} AS ok FROM g) "
    "SELECT event_id, CASE WHEN len(b) > 0 THEN array_to_string(b, ' ') ELSE 'command_observed' END AS behaviours, CASE WHEN ok THEN 'Benign' ELSE 'Context_Dependent' END AS verdict, CASE WHEN ok AND contains(lower(command), 'sudo') THEN 'authorized' ELSE 'unknown' END AS authorization FROM r"
)
def rev5_rubric_review(spark, sf_dir):
    return gallery(spark, sf_dir, ADMIN_SQL).select("event_id", assembly.rubric_review(F.col("command")).alias("r")).select("event_id", F.array_join("r.behaviours", " ").alias("behaviours"), "r.verdict", "r.authorization")


_NAMES = [p[0] for p in assembly.POLICIES] + ["unknown_bucket"]
_POLICY = "(VALUES " + ", ".join(str(p) for p in assembly.POLICIES) + ") t(bucket, r, c, a, label_basis, source_type)"
_SOFT = f"WITH d AS (SELECT doc_id, {_NAMES!r}[1 + doc_id % {len(_NAMES)}] AS bucket FROM documents), p AS (SELECT doc_id, label_basis, source_type, round(r / (r + c + a), 6) AS routine, round(c / (r + c + a), 6) AS context, round(a / (r + c + a), 6) AS abuse FROM d JOIN {_POLICY} USING (bucket))"


def soft(spark, sf_dir):
    bucket = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % len(_NAMES) + 1).cast("int"))
    return assembly.with_policy(docs(spark, sf_dir).select("doc_id", bucket.alias("bucket")), "bucket")


@query(_SOFT + " SELECT * FROM p")
def n13_soft_label_policy(spark, sf_dir):
    return soft(spark, sf_dir).select("doc_id", "label_basis", "source_type", "soft_target.*")


@query(_SOFT + " SELECT label_basis, count(*) AS n, round(avg(context + abuse), 6) AS non_benign_mean, round(avg((context + abuse) * 0.5), 6) AS ordinal_risk_mean, array_to_string(list_sort(list(doc_id))[1:3], ' ') AS examples FROM p GROUP BY 1")
def agg7_soft_label_report(spark, sf_dir):
    report = assembly.soft_label_report(soft(spark, sf_dir), "doc_id")
    return report.withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), " "))


@query("WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), g AS (SELECT CAST(floor(greatest(quantile_cont(n, 0.5), 4 * min(n))) AS BIGINT) AS goal FROM s) SELECT lang, greatest(n, least(goal, n * 1000)) AS n FROM s, g")
def dst14_oversampling(spark, sf_dir):
    return assembly.oversampled(docs(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n, 1 AS n_splits FROM documents GROUP BY 1")
def dst10_dst11_isolated_split(spark, sf_dir):
    """What this SQL tells is that no group is divided or lost; dst10_component_split and dst11_label_balanced_split hold the dealing."""
    rows = splits.isolated_split(docs(spark, sf_dir).select("doc_id", "source"), "source")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("split").cast("int").alias("n_splits"))


@query(f"SELECT doc_id, CASE WHEN CAST('0x' || sha256({KEY})[1:2] AS INTEGER) < 205 THEN 'train' ELSE 'test' END AS split FROM documents")
def dst13_disjointness_gate(spark, sf_dir):
    key = F.sha2(dedup_key(F.col("text")), 256)
    rows = docs(spark, sf_dir).withColumn("split", F.when(F.conv(F.substring(key, 1, 2), 16, 10).cast("int") < 205, "train").otherwise("test"))
    return assembly.disjoint(rows, key, "split").select("doc_id", "split")


_PARTS = f"WITH k AS (SELECT DISTINCT sha256({KEY}) AS key, 'documents/' || lang AS part FROM documents UNION SELECT DISTINCT sha256({KEY}), 'conversations/' || role FROM conversations UNION SELECT DISTINCT sha256({KEY}), 'documents/copy' FROM documents WHERE n_chars < 400)"


@query(_PARTS + " SELECT a.part AS left_split, b.part AS right_split, count(*) AS shared FROM k a JOIN k b ON a.key = b.key AND a.part < b.part GROUP BY 1, 2")
def joi6_exposure_matrix(spark, sf_dir):
    d, c = docs(spark, sf_dir), docs(spark, sf_dir, "conversations")
    part = lambda df, p: df.select("text", p.alias("part"))
    rows = part(d, F.concat(F.lit("documents/"), "lang")).unionByName(part(c, F.concat(F.lit("conversations/"), "role"))).unionByName(part(d.filter("n_chars < 400"), F.lit("documents/copy")))
    return datasets.split_overlaps(rows, F.sha2(dedup_key(F.col("text")), 256), "part")


_MODEL = "SELECT vec_id, {0} AS truth, {1} AS a, {2} AS b FROM embeddings"
_MODELS = "WITH m AS (" + _MODEL.format("label % 3", "CASE WHEN vec_id % 5 < 3 THEN label % 3 ELSE (label + 1) % 3 END", "CASE WHEN vec_id % 7 < 4 THEN label % 3 ELSE (label + 1 + vec_id % 2) % 3 END") + ")"
_REASON = "CASE WHEN a <> truth AND b <> truth AND a = b THEN 'both_wrong_alike' WHEN a <> truth AND b <> truth THEN 'both_wrong_apart' WHEN a <> truth THEN 'first_wrong' WHEN b <> truth THEN 'second_wrong' END"


def models(spark, sf_dir):
    label, v = F.col("label"), F.col("vec_id")
    rows = docs(spark, sf_dir, "embeddings")
    first = rows.select("vec_id", F.when(v % 5 < 3, label % 3).otherwise((label + 1) % 3).alias("label"))
    second = rows.select("vec_id", F.when(v % 7 < 4, label % 3).otherwise((label + 1 + v % 2) % 3).alias("label"))
    return rows.select("vec_id", (label % 3).alias("truth")), first, second


@query(_MODELS + f" SELECT reason, a, b, count(*) AS n FROM (SELECT *, {_REASON} AS reason FROM m) WHERE reason IS NOT NULL GROUP BY ALL")
def joi12_disagreements(spark, sf_dir):
    return assembly.disagreements(*models(spark, sf_dir), "vec_id").groupBy("reason", "a", "b").agg(F.count("*").alias("n"))


@query(
    _MODELS + f", f AS (SELECT *, {_REASON} AS reason, sha256(CAST(vec_id AS VARCHAR)) AS h FROM m), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id % 300 ORDER BY reason, h) AS t FROM f WHERE reason IS NOT NULL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY h) <= 10 AS own FROM o WHERE t = 1), q AS (SELECT *, row_number() OVER (ORDER BY own DESC, h) AS n FROM r) SELECT vec_id, reason, CASE WHEN own THEN 'quota' ELSE 'fill' END AS chosen FROM q WHERE n <= 40"
)
def rev3_review_queue(spark, sf_dir):
    found = assembly.disagreements(*models(spark, sf_dir), "vec_id")
    return assembly.review_queue(found, "vec_id", F.col("vec_id") % 300, 40).select("vec_id", "reason", "chosen")


@query(
    _MODELS + " SELECT policy, count(*) AS n, round(avg(CAST(guess = truth AS INTEGER)), 6) AS accuracy, round(count(*) FILTER (truth = 0 AND guess = 1) / count(*) FILTER (truth = 0), 6) AS benign_as_1 FROM "
    "(SELECT truth, 'raw' AS policy, a AS guess FROM m UNION ALL SELECT truth, 'decoded', b FROM m UNION ALL SELECT truth, 'riskier', greatest(a, b) FROM m) GROUP BY 1"
)
def joi8_view_policies(spark, sf_dir):
    truth, first, second = models(spark, sf_dir)
    rows = truth.join(first.withColumnRenamed("label", "a"), "vec_id").join(second.withColumnRenamed("label", "b"), "vec_id")
    guess = F.explode(F.create_map(F.lit("raw"), "a", F.lit("decoded"), "b", F.lit("riskier"), F.greatest("a", "b"))).alias("policy", "guess")
    own = F.col("truth") == 0
    return rows.select("truth", guess).groupBy("policy").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("guess") == F.col("truth")).cast("int")), 6).alias("accuracy"), F.round(F.sum((own & (F.col("guess") == 1)).cast("int")) / F.sum(own.cast("int")), 6).alias("benign_as_1"),
    )


@query(
    RULED + _STRENGTH + ", fired AS (SELECT event_id, unnest(string_split(fired_rules, ' ')) AS rule FROM rs), mm AS (SELECT event_id, event_id % 3 = 0 AS truth, event_id % 2 = 0 AS was, event_id % 5 < 3 AS now FROM g) "
    "SELECT rule, CAST(sum(CAST(was <> truth AND now = truth AS INTEGER)) AS BIGINT) AS fixes, CAST(sum(CAST(was = truth AND now <> truth AS INTEGER)) AS BIGINT) AS breaks, CAST(sum(CAST(now = truth AS INTEGER) - CAST(was = truth AS INTEGER)) AS BIGINT) AS net FROM fired JOIN mm USING (event_id) WHERE rule <> '' GROUP BY 1"
)
def agg10_rule_fixes(spark, sf_dir):
    e = F.col("event_id")
    rows = ruled(spark, sf_dir).withColumns({"truth": e % 3 == 0, "was": e % 2 == 0, "now": e % 5 < 3})
    return assembly.fixes_and_breaks(rows, "was", "now", "truth")


@query("SELECT doc_id, CASE WHEN n_chars > 1000 THEN sha256(text) END AS digest FROM documents")
def rte6_gated_stage(spark, sf_dir):
    rows = docs(spark, sf_dir)
    return assembly.gated(rows, F.col("n_chars") > 1000, lambda df: df.withColumn("digest", F.sha2("text", 256))).select("doc_id", "digest")


@query("WITH m AS (SELECT vec_id % 2 AS split, label % 3 AS t, CASE WHEN vec_id % 5 < 3 THEN label % 3 ELSE (label + 1) % 3 END AS a, CASE WHEN vec_id % 7 < 4 THEN label % 3 ELSE (label + 1 + vec_id % 2) % 3 END AS b FROM embeddings), "
       "x AS (SELECT split, avg(CAST(a = t AS INTEGER)) AS was, avg(CAST(b = t AS INTEGER)) AS now FROM m GROUP BY 1) SELECT CASE WHEN bool_and(now > was) THEN 'adopt' WHEN bool_or(now > was) THEN 'mixed' ELSE 'skip' END AS decision, count(*) AS n_splits FROM x")  # fmt: skip
def eva17_adoption(spark, sf_dir):
    truth, first, second = models(spark, sf_dir)
    rows = truth.join(first.withColumnRenamed("label", "a"), "vec_id").join(second.withColumnRenamed("label", "b"), "vec_id")
    by = rows.groupBy((F.col("vec_id") % 2).alias("split")).agg(*[F.avg((F.col(c) == F.col("truth")).cast("int")).alias(n) for c, n in (("a", "was"), ("b", "now"))])
    better = F.col("now") > F.col("was")
    return by.agg(F.when(F.bool_and(better), "adopt").when(F.bool_or(better), "mixed").otherwise("skip").alias("decision"), F.count("*").alias("n_splits"))


_DRAWN = f", d AS (SELECT CAST(unnest(range(1, 201)) AS BIGINT) AS draw), w AS (SELECT family, draw, {bootstrap.weights_sql('family', 0, 'draw')} AS w FROM (SELECT DISTINCT vec_id % 40 AS family FROM m) CROSS JOIN d)"


def _macro_sql(guess: str) -> str:
    f1 = [f"CASE WHEN sum(w * (CAST(truth = {c} AS INT) + CAST({guess} = {c} AS INT))) > 0 THEN 2 * sum(w * CAST(truth = {c} AND {guess} = {c} AS INT)) / sum(w * (CAST(truth = {c} AS INT) + CAST({guess} = {c} AS INT))) ELSE 0.0 END" for c in range(3)]
    return f"(({') + ('.join(f1)})) / 3"


@query(_MODELS + _DRAWN + f", x AS (SELECT draw, {_macro_sql('a')} AS m FROM m JOIN w ON w.family = m.vec_id % 40 GROUP BY 1) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.975), 6) AS high, count(*) AS draws FROM x")
def eva10_bootstrap_macro_f1(spark, sf_dir):
    truth, first, _ = models(spark, sf_dir)
    rows = truth.join(first, "vec_id").select((F.col("vec_id") % 40).alias("family"), F.col("truth").alias("target"), F.col("label").alias("prediction"))
    return bootstrap.macro_f1(rows, "family", [0, 1, 2], 200)


def paired(spark, sf_dir):
    """Two models' rankings of three classes: the guess, then the next class."""
    truth, first, second = models(spark, sf_dir)
    side = lambda df: truth.join(df, "vec_id").select("vec_id", (F.col("vec_id") % 40).alias("family"), F.col("truth").alias("target"), F.array("label", (F.col("label") + 1) % 3, (F.col("label") + 2) % 3).alias("ranked"))
    return bootstrap.paired_rows(side(first), side(second).drop("family"), "vec_id", "family")


_TOP2 = "(CAST(truth IN (b, (b + 1) % 3) AS INT) - CAST(truth IN (a, (a + 1) % 3) AS INT))"
_TOP1 = "(CAST(truth = b AS INT) - CAST(truth = a AS INT))"
_ENDS = ", ".join(f"round(quantile_cont({n}, {q}), 6) AS {n}_{end}" for n in ("top1", "top2", "macro_f1") for end, q in (("low", 0.025), ("high", 0.975)))


@query(
    _MODELS + _DRAWN + f", x AS (SELECT draw, sum(w * {_TOP1}) / sum(w) AS top1, sum(w * {_TOP2}) / sum(w) AS top2, {_macro_sql('b')} - {_macro_sql('a')} AS macro_f1 FROM m JOIN w ON w.family = m.vec_id % 40 GROUP BY 1), "
    f"y AS (SELECT {_ENDS} FROM x), v AS (SELECT *, 1 AS w FROM m), z AS (SELECT count(*) AS n, count(DISTINCT vec_id % 40) AS groups, round(avg({_TOP1}), 6) AS top1, round(avg({_TOP2}), 6) AS top2, round({_macro_sql('b')} - {_macro_sql('a')}, 6) AS macro_f1 FROM v) SELECT * FROM z, y"
)
def eva9_eva10_paired_comparison(spark, sf_dir):
    found = bootstrap.paired_comparison(paired(spark, sf_dir), "family", [0, 1, 2], (1, 2), 200, 0)
    return found.select("n", "groups", *[F.round(c, 6).alias(c) for c in found.columns[2:]])


@query(_MODELS + " SELECT vec_id % 40 AS family, count(*) AS n, CAST(sum(CAST(a = truth AS INT)) AS BIGINT) AS hits_a, CAST(sum(CAST(b = truth AS INT)) AS BIGINT) AS hits_b, round(avg(" + _TOP1 + "), 6) AS delta FROM m GROUP BY 1")
def eva9_family_deltas(spark, sf_dir):
    return bootstrap.family_deltas(paired(spark, sf_dir), "family").withColumn("delta", F.round("delta", 6))
