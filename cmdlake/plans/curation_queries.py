"""Queries of corpus curation, review and reporting, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cmdlake.functions import weak_labels
from cmdlake.functions.text import dedup_key
from cmdlake.operators.digests import ordered_digests
from cmdlake.operators import curation, triage
from cmdlake.plans.dataset_queries import KEY, docs
from cmdlake.plans.triage_queries import FEATURES, PARSED, RULED, featured, parsed
from cmdlake.sources.gallery import ADMIN_SQL, GALLERY_SQL, gallery

QUERIES, ORACLE = {}, {}
JOINED = "WITH l AS (SELECT doc_id, source, lang, n_chars, text, quality, toxic FROM documents JOIN labels USING (doc_id))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def joined(spark, sf_dir):
    return docs(spark, sf_dir).join(docs(spark, sf_dir, "labels"), "doc_id")


def keyed(df):
    return df.withColumn("key", F.sha2(dedup_key(F.col("text")), 256))


_MADE = "'$ ' || replace(command, 'user', '{{ user }}') || ' #{ path : default }  '"
_BARE = r"regexp_replace(regexp_replace(regexp_replace(s, '^\s*[$#>]\s+', ''), '^\s*PS[^>]*>\s+', ''), '\s+', ' ', 'g')"
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query(
    f"WITH g AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '- ' || command WHEN event_id % 11 = 1 THEN '12 . 34' WHEN event_id % 11 = 2 THEN 'PS C:> ' || command ELSE {_MADE} END AS c FROM ({GALLERY_SQL})), "
    rf"a AS (SELECT event_id, regexp_replace(regexp_replace({_TRIM.format('c')}, '\{{\{{\s*([^{{}}]+?)\s*\}}\}}', '\1', 'g'), '#\{{\s*([^{{}}:]+?)\s*(?::[^{{}}]*)?\}}', '$\1', 'g') AS s FROM g), "
    rf"b AS (SELECT event_id, {_TRIM.format(_BARE)} AS s FROM a) "
    r"SELECT event_id, CASE WHEN length(s) BETWEEN 2 AND 2048 AND regexp_matches(s, '[A-Za-z]') AND NOT regexp_matches(s, '^(\||- |\* |> )') THEN s END AS cleaned FROM b"
)
def n4_corpus_cleaner(spark, sf_dir):
    made = F.concat(F.lit("$ "), F.replace("command", F.lit("user"), F.lit("{{ user }}")), F.lit(" #{ path : default }  "))
    k = F.col("event_id") % 11
    line = F.when(k == 0, F.concat(F.lit("- "), "command")).when(k == 1, "12 . 34").when(k == 2, F.concat(F.lit("PS C:> "), "command")).otherwise(made)
    return gallery(spark, sf_dir).select("event_id", curation.cleaned_command(line).alias("cleaned"))


@query(
    rf"WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT doc_id, {_TRIM.format('line')} AS s FROM x) SELECT doc_id, count(*) AS n, min(s) AS first_line, max(s) AS last_line FROM s "
    r"WHERE s <> '' AND NOT starts_with(s, '#') AND NOT regexp_matches(s, '^(\$[A-Za-z_]\w*|[A-Z][A-Z0-9_]*|export\s+[A-Za-z_]\w*)\s*=') AND NOT regexp_matches(s, '^[!:\\]') AND NOT regexp_matches(s, '^[|&;<>{}()\[\]\s]+$') AND s NOT IN ('EOF', 'EOT', 'END', '}', ')', ']', chr(39), chr(34)) GROUP BY 1"
)
def n5_script_lines(spark, sf_dir):
    lines = docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", curation.script_line(F.col("line")).alias("s")).filter("s is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("s").alias("first_line"), F.max("s").alias("last_line"))


@query("SELECT doc_id, CASE WHEN source <> '' THEN 'source:' || source WHEN lang <> '' THEN 'lang:' || lang ELSE text END AS row_group FROM documents")
def n7_row_group(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", curation.row_group(F.col("text"), "source", "lang").alias("row_group"))


_P = "(value % 100) / 100.0"


@query(f"WITH p AS (SELECT event_id, {_P} AS r, (1 - {_P}) * 0.7 AS c, (value * 3 % 50) / 100.0 AS a FROM events) SELECT event_id, round(r / (r + c + a), 6) AS routine, round((c + a) / (r + c + a), 6) AS non_benign, round((c + a) / (r + c + a) * 0.5, 6) AS ordinal_risk FROM p")
def n11_n12_soft_targets(spark, sf_dir):
    r = (F.col("value") % 100) / 100.0
    rows = docs(spark, sf_dir, "events").select("event_id", curation.two_way_target(r, (1 - r) * 0.7, (F.col("value") * 3 % 50) / 100.0).alias("t"))
    return rows.select("event_id", *[F.round(f"t.{x}", 6).alias(x) for x in ("routine", "non_benign", "ordinal_risk")])


_W = ["{c}", "/usr/bin/{c}", "command -v {f} >/dev/null && {c}", "command {c}", "bash -lc {c}", "sh -c {c}", "env -i PATH=/usr/bin:/bin sh -c {c}"]


@query(f"SELECT p_partkey, w.i AS variant, replace(replace(w.t, '{{c}}', p_name), '{{f}}', split_part(p_name, ' ', 1)) AS command FROM part CROSS JOIN (SELECT unnest({list(range(7))}) AS i, unnest({_W}) AS t) w")
def dst17_n15_wrapper_variants(spark, sf_dir):
    forms = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(_W)])).alias("w")
    rows = docs(spark, sf_dir, "part").select("p_partkey", "p_name", forms)
    return rows.select("p_partkey", F.col("w.i").alias("variant"), F.replace(F.replace(F.col("w.t"), F.lit("{c}"), F.col("p_name")), F.lit("{f}"), F.substring_index("p_name", " ", 1)).alias("command"))


@query("WITH p AS (SELECT event_id, round((value % 100) / 100.0, 4) AS a, round((value * 7 % 100) / 100.0, 4) AS b FROM events), m AS (SELECT event_id, (a + b) / 2 AS benign FROM p) SELECT event_id, CASE WHEN benign >= 0.5 THEN 'Benign' ELSE 'Suspicious' END AS label, round(greatest(benign, 1 - benign), 6) AS confidence FROM m")
def rte3_rte4_view_fusion(spark, sf_dir):
    a, b = F.round((F.col("value") % 100) / 100.0, 4), F.round((F.col("value") * 7 % 100) / 100.0, 4)
    rows = docs(spark, sf_dir, "events").select("event_id", curation.fused(F.array(a, 1 - a), F.array(b, 1 - b), "mean").alias("p"))
    benign = F.col("p")[0]
    return rows.select("event_id", F.when(benign >= 0.5, "Benign").otherwise("Suspicious").alias("label"), F.round(F.greatest(benign, 1 - benign), 6).alias("confidence"))


_FAMS = "list_filter([CASE WHEN quality = 1 THEN 'Benign Admin' END, CASE WHEN toxic = 1 THEN 'Impact' END, CASE WHEN n_chars > 3000 THEN 'Collection' END], lambda f: f IS NOT NULL)"


@query(
    JOINED + f", f AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'Benign' ELSE 'Suspicious' END AS gate, {_FAMS} AS fams FROM l) SELECT doc_id, CASE WHEN list_contains(fams, 'Benign Admin') AND len(fams) = 1 THEN CASE WHEN gate <> 'Benign' THEN 'gate_family_disagreement' ELSE 'benign_family_candidate' END "
    "WHEN list_contains(fams, 'Benign Admin') THEN 'mixed_family_prediction' WHEN len(fams) > 0 THEN 'attack_family_candidate' ELSE 'no_family_selected' END AS status FROM f"
)
def rte7_consistency(spark, sf_dir):
    fams = F.array_compact(F.array(F.when(F.col("quality") == 1, "Benign Admin"), F.when(F.col("toxic") == 1, "Impact"), F.when(F.col("n_chars") > 3000, "Collection")))
    return joined(spark, sf_dir).select("doc_id", curation.consistency(F.when(F.col("lang") == "en", "Benign").otherwise("Suspicious"), fams, "Benign Admin").alias("status"))


@query("WITH s AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings), r AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, 'T' || lpad(CAST(i AS VARCHAR), 4, '0')) AS n FROM s) SELECT vec_id, string_agg('T' || lpad(CAST(i AS VARCHAR), 4, '0'), ' ' ORDER BY n) AS top5 FROM r WHERE n <= 5 GROUP BY 1")
def fam2_top_techniques(spark, sf_dir):
    scores = F.transform("embedding", lambda v, i: F.struct(F.concat(F.lit("T"), F.lpad(i.cast("string"), 4, "0")).alias("name"), v.cast("double").alias("score")))
    return docs(spark, sf_dir, "embeddings").select("vec_id", F.array_join(curation.top_k(scores, 5, float("-inf")), " ").alias("top5"))


_TAGS = "list_filter([" + ", ".join(f"CASE WHEN {f} THEN '{t}' END" for f, t in curation.TAGS) + "], lambda m: m IS NOT NULL)"


@query(RULED + f", t AS (SELECT event_id, x, array_to_string({_TAGS}, ' ') AS tags FROM s) SELECT event_id, tags, CASE WHEN tags <> '' THEN tags || ' | ' || x ELSE x END AS hybrid FROM t")
def res1_res2_tagged_text(spark, sf_dir):
    return featured(spark, sf_dir).select("event_id", F.array_join(curation.semantic_tags(), " ").alias("tags"), curation.tagged_text().alias("hybrid"))


_PHRASES = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{w}' END" for c, w in curation.PHRASES) + "], lambda m: m IS NOT NULL)"


@query(RULED + f", t AS (SELECT event_id, exe, {_PHRASES} AS w FROM s) SELECT event_id, CASE WHEN len(w) > 0 THEN exe || ' displaying ' || array_to_string(w, ', ') ELSE exe || ' execution' END AS summary FROM t")
def ioc8_summary(spark, sf_dir):
    return featured(spark, sf_dir).select("event_id", curation.summary_sentence().alias("summary"))


@query(RULED + ", fr AS (SELECT event_id, sem.n AS n FROM (SELECT event_id, unnest([" + ", ".join(f"CASE WHEN {f} THEN '{f}' END" for f in FEATURES) + "]) AS n FROM s) sem WHERE sem.n IS NOT NULL) SELECT n AS feature, count(*) AS n_commands FROM fr GROUP BY 1")
def res6_feature_frequencies(spark, sf_dir):
    return featured(spark, sf_dir).select(F.explode_outer("feature_tags").alias("feature")).filter("feature is not null").groupBy("feature").agg(F.count("*").alias("n_commands"))


_K = f"sha256({KEY})"


@query(
    f"WITH d AS (SELECT doc_id, source, {_K} AS key FROM documents UNION ALL SELECT 10000000 + item_id, 'benchmark', {_K} FROM benchmark), s AS (SELECT source, CASE WHEN key IN (SELECT {_K} FROM benchmark) THEN 'existing' WHEN row_number() OVER (PARTITION BY key ORDER BY doc_id) > 1 THEN 'internal_duplicate' ELSE 'accepted' END AS status FROM d) "
    "SELECT source, status, count(*) AS n FROM s GROUP BY 1, 2"
)
def joi2_agg12_against_existing(spark, sf_dir):
    known = keyed(docs(spark, sf_dir, "benchmark"))
    new = keyed(docs(spark, sf_dir)).select("doc_id", "source", "key").union(known.select(F.col("item_id") + 10000000, F.lit("benchmark"), "key"))
    return curation.against_existing(new, known, "key", "doc_id").groupBy("source", "status").agg(F.count("*").alias("n"))


@query(JOINED + ", g AS (SELECT 'source' AS axis, source AS value, toxic FROM l UNION ALL SELECT 'lang', lang, toxic FROM l) SELECT axis, value, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(DISTINCT toxic) > 1")
def joi5_group_overlap(spark, sf_dir):
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in ("source", "lang")])).alias("g")
    rows = joined(spark, sf_dir).select(axes, "toxic").groupBy("g.axis", "g.value").agg(F.count("*").alias("n"), F.min("toxic").alias("lo"), F.max("toxic").alias("hi"))
    return rows.filter("lo <> hi").select("axis", "value", "n")


@query("SELECT count(*) FILTER (l.doc_id IS NULL) AS only_left, count(*) FILTER (d.doc_id IS NULL) AS only_right, count(*) FILTER (l.quality = 1 AND l.toxic = 0) AS both_right, count(*) FILTER (l.quality = 1 AND l.toxic = 1) AS first_right FROM documents d FULL JOIN labels l USING (doc_id)")
def joi7_paired_keys(spark, sf_dir):
    left, right = docs(spark, sf_dir).select("doc_id", F.lit(1).alias("d")), docs(spark, sf_dir, "labels").withColumn("l", F.lit(1))
    both = left.join(right, "doc_id", "full")
    n = lambda cond, name: F.count(F.when(F.expr(cond), 1)).alias(name)
    return both.agg(n("l is null", "only_left"), n("d is null", "only_right"), n("quality = 1 and toxic = 0", "both_right"), n("quality = 1 and toxic = 1", "first_right"))


@query(JOINED + " SELECT doc_id, CASE WHEN quality = 1 - toxic THEN quality WHEN lang = 'en' THEN CAST(n_chars > 1000 AS INTEGER) ELSE -1 END AS verdict, CASE WHEN quality = 1 - toxic OR lang = 'en' THEN 'accepted' ELSE 'unresolved' END AS status FROM l")
def joi9_rev6_reconciled(spark, sf_dir):
    rows = joined(spark, sf_dir)
    third = docs(spark, sf_dir).filter("lang = 'en'").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("verdict"))
    found = curation.reconciled(rows.select("doc_id", F.col("quality").alias("verdict")), rows.select("doc_id", (1 - F.col("toxic")).alias("verdict")), third, "doc_id")
    return found.select("doc_id", F.coalesce("verdict", F.lit(-1)).cast("int").alias("verdict"), "status")


@query("SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'low' ELSE d.lang END AS label, l.doc_id IS NOT NULL AND (l.toxic = 1 OR l.quality = 0) AS corrected FROM documents d LEFT JOIN labels l USING (doc_id)")
def joi10_corrections(spark, sf_dir):
    fixes = docs(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").alias("new")).filter("new is not null")
    return docs(spark, sf_dir).join(fixes, "doc_id", "left").select("doc_id", F.coalesce("new", "lang").alias("label"), F.col("new").isNotNull().alias("corrected"))


@query(
    "WITH h AS (SELECT user_id, event_type, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1, 2), m AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS mid FROM events), t AS (SELECT user_id, list(event_type) AS x FROM h, m WHERE a < mid GROUP BY 1), p AS (SELECT user_id, list(event_type) AS x FROM h, m WHERE b >= mid GROUP BY 1) "
    "SELECT CAST(sum(len(list_intersect(t.x, p.x))) AS BIGINT) AS hits, CAST(sum(len(t.x)) AS BIGINT) AS n_truth, CAST(sum(len(p.x)) AS BIGINT) AS n_predicted, count(*) AS n_users FROM t JOIN p USING (user_id)"
)
def joi11_eva13_relevance(spark, sf_dir):
    e = docs(spark, sf_dir, "events")
    half = e.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("mid"))  # one row
    spans = e.groupBy("user_id", "event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).crossJoin(F.broadcast(half))
    sets = lambda cond, name: spans.filter(cond).groupBy("user_id").agg(F.collect_set("event_type").alias(name))
    both = sets("a < mid", "t").join(sets("b >= mid", "p"), "user_id")
    return both.agg(F.sum(F.size(F.array_intersect("t", "p"))).alias("hits"), F.sum(F.size("t")).alias("n_truth"), F.sum(F.size("p")).alias("n_predicted"), F.count("*").alias("n_users"))


@query("WITH k AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) SELECT source IN (SELECT source FROM k) AS known, count(*) AS n FROM documents GROUP BY 1")
def joi14_label_conformance(spark, sf_dir):
    known = joined(spark, sf_dir).filter("toxic = 1").select("source").distinct().withColumn("known", F.lit(True))
    return docs(spark, sf_dir).join(known, "source", "left").groupBy(F.coalesce("known", F.lit(False)).alias("known")).agg(F.count("*").alias("n"))


@query(f"WITH d AS (SELECT {_K} AS key, source, toxic FROM documents LEFT JOIN labels USING (doc_id)) SELECT key, array_to_string(list_sort(list(DISTINCT source)), ' ') AS sources, count(*) AS rows_merged, count(DISTINCT toxic) > 1 AS conflict FROM d GROUP BY 1")
def agg4_multi_label_merge(spark, sf_dir):
    rows = keyed(docs(spark, sf_dir)).select("doc_id", "key", "source").join(docs(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("source")), " ").alias("sources"), F.count("*").alias("rows_merged"), F.coalesce(F.min("toxic") != F.max("toxic"), F.lit(False)).alias("conflict"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, count(DISTINCT user_id) AS n_users, max_by(event_id, value * 1000000 - event_id / 1000000.0) AS best FROM events GROUP BY 1")
def agg8_run_summary(spark, sf_dir):
    return docs(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("deviation"), F.count_distinct("user_id").alias("n_users"), F.max_by("event_id", F.expr("value * 1000000 - event_id / 1000000.0D")).alias("best"))


@query(JOINED + " SELECT source, count(*) AS n, CAST(sum(CAST(quality = toxic AS BIGINT)) AS BIGINT) AS disagree, CAST(sum(CAST(toxic = 1 AND quality = 1 AS BIGINT)) AS BIGINT) AS escalated FROM l GROUP BY 1")
def agg9_triage_disagreement(spark, sf_dir):
    total = lambda cond, name: F.sum(F.expr(cond).cast("long")).alias(name)
    return joined(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), total("quality = toxic", "disagree"), total("toxic = 1 and quality = 1", "escalated"))


@query(JOINED + " SELECT coalesce(lang, 'ALL') AS bucket, count(*) AS n, round(avg(CAST(quality = 1 AS DOUBLE)), 6) AS base_accuracy, round(avg(CAST(toxic = 0 AS DOUBLE)), 6) AS prior_accuracy FROM l GROUP BY GROUPING SETS ((lang), ())")
def agg11_accuracy_by_bucket(spark, sf_dir):
    rate = lambda cond, name: F.round(F.avg(F.expr(cond).cast("double")), 6).alias(name)
    return joined(spark, sf_dir).rollup("lang").agg(F.count("*").alias("n"), rate("quality = 1", "base_accuracy"), rate("toxic = 0", "prior_accuracy")).select(F.coalesce("lang", F.lit("ALL")).alias("bucket"), "n", "base_accuracy", "prior_accuracy")


@query("SELECT source, min_by(doc_id, sha256('5:' || CAST(doc_id AS VARCHAR))) AS doc_id FROM documents GROUP BY 1")
def win5_template_representative(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("source").agg(F.min_by("doc_id", F.sha2(F.concat(F.lit("5:"), F.col("doc_id").cast("string")), 256)).alias("doc_id"))


@query("SELECT 'documents' AS origin, doc_id AS row_id, lang FROM documents UNION ALL SELECT 'benchmark', item_id, NULL FROM benchmark UNION ALL SELECT 'pages', page_id, NULL FROM pages")
def set1_union(spark, sf_dir):
    d, b, p = (docs(spark, sf_dir, n) for n in ("documents", "benchmark", "pages"))
    parts = [d.select(F.lit("documents").alias("origin"), F.col("doc_id").alias("row_id"), "lang"), b.select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("row_id")), p.select(F.lit("pages").alias("origin"), F.col("page_id").alias("row_id"))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


@query(
    JOINED + ", c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (toxic = 1) AS m, count(*) FILTER (quality = 0 AND toxic = 0) AS c FROM l), t AS (SELECT *, greatest(b + m + c, ceil(b / 0.6), ceil(m / 0.25), ceil(c / 0.15)) AS total FROM c) "
    "SELECT 'Benign' AS label, CAST(0 AS BIGINT) AS deficit FROM t UNION ALL SELECT 'Malicious', CAST(greatest(m, ceil(total * 0.25)) - m AS BIGINT) FROM t UNION ALL SELECT 'Context', CAST(greatest(c, ceil(total * 0.15)) - c AS BIGINT) FROM t"
)
def dst3_ratio_deficits(spark, sf_dir):
    label = F.when(F.col("toxic") == 1, "Malicious").when(F.col("quality") == 0, "Context").otherwise("Benign")
    counts = {r["label"]: r["n"] for r in joined(spark, sf_dir).groupBy(label.alias("label")).agg(F.count("*").alias("n")).collect()}  # a row a class
    missing = curation.ratio_deficits({c: counts.get(c, 0) for c in ("Benign", "Malicious", "Context")}, {"Benign": 0.6, "Malicious": 0.25, "Context": 0.15}, "Benign")
    return spark.createDataFrame(sorted(missing.items()), "label string, deficit long")


@query("WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT *, n * 100 / sum(n) OVER () AS share FROM c), r AS (SELECT source, n, floor(share) AS f, row_number() OVER (ORDER BY share - floor(share) DESC, source) AS k, 100 - sum(floor(share)) OVER () AS spare FROM s) SELECT source, n, CAST(f + CASE WHEN k <= spare THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r")
def dst7_scaled_quotas(spark, sf_dir):
    return curation.largest_remainder(docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n")), "source", "n", 100)


@query("WITH g AS (SELECT source, count(*) AS n, sha256('3:' || source) AS h FROM documents GROUP BY 1), m AS (SELECT source, coalesce(sum(n) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < round(sum(n) OVER () * 0.2) AS holdout FROM g) SELECT doc_id, holdout FROM documents JOIN m USING (source)")
def dst12_group_holdout(spark, sf_dir):
    return curation.held_out_groups(docs(spark, sf_dir).select("doc_id", "source"), "source", 0.2, 3).select("doc_id", "holdout")


@query(JOINED + ", r AS (SELECT doc_id, source, quality, row_number() OVER (PARTITION BY source, quality ORDER BY sha256('9:' || CAST(doc_id AS VARCHAR))) AS n FROM l), q AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY sha256('9:' || CAST(doc_id AS VARCHAR))) AS k FROM r WHERE n = 1) SELECT doc_id, source, quality FROM q WHERE k <= 8")
def rev2_balanced_queue(spark, sf_dir):
    h = F.sha2(F.concat(F.lit("9:"), F.col("doc_id").cast("string")), 256)
    one = joined(spark, sf_dir).groupBy("source", "quality").agg(F.min_by("doc_id", h).alias("doc_id"))
    return one.withColumn("k", F.row_number().over(Window.partitionBy("quality").orderBy(h))).filter("k <= 8").select("doc_id", "source", "quality")


@query(JOINED + f" SELECT sha256({KEY}) AS item, count(*) AS n FROM l WHERE quality = toxic GROUP BY 1")
def rev4_conflict_queue(spark, sf_dir):
    return keyed(joined(spark, sf_dir).filter("quality = toxic")).groupBy(F.col("key").alias("item")).agg(F.count("*").alias("n"))


@query("SELECT 'unknown_document' AS problem, count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'good_and_toxic', count(*) FROM labels WHERE quality = 1 AND toxic = 1 UNION ALL SELECT 'duplicate', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) - 1 AS n FROM labels GROUP BY doc_id HAVING count(*) > 1)")
def rev7_correction_problems(spark, sf_dir):
    labels = docs(spark, sf_dir, "labels")
    lost = labels.join(docs(spark, sf_dir).select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("n"))
    both = labels.filter("quality = 1 and toxic = 1").agg(F.count("*").alias("n"))
    twice = labels.groupBy("doc_id").agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("n"))
    parts = [df.select(F.lit(name).alias("problem"), "n") for name, df in (("unknown_document", lost), ("good_and_toxic", both), ("duplicate", twice))]
    return parts[0].union(parts[1]).union(parts[2])


_T, _Q = "list_filter([CASE WHEN quality = 0 THEN 'low' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN lang = 'en' THEN 'english' END], lambda x: x IS NOT NULL)", "list_filter([CASE WHEN n_chars < 900 THEN 'low' END, CASE WHEN n_chars % 7 = 0 THEN 'toxic' END, CASE WHEN source < 'src15' THEN 'english' END], lambda x: x IS NOT NULL)"


@query(
    JOINED + f", s AS (SELECT {_T} AS t, {_Q} AS p FROM l), e AS (SELECT unnest(['low', 'toxic', 'english']) AS label, t, p FROM s), n AS (SELECT label, CAST(sum(CAST(list_contains(t, label) AND list_contains(p, label) AS BIGINT)) AS BIGINT) AS tp, CAST(sum(CAST(NOT list_contains(t, label) AND list_contains(p, label) AS BIGINT)) AS BIGINT) AS fp, "
    "CAST(sum(CAST(list_contains(t, label) AND NOT list_contains(p, label) AS BIGINT)) AS BIGINT) AS fn FROM e GROUP BY 1) SELECT label, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM n WHERE tp + fp + fn > 0"
)
def eva5_multi_label_report(spark, sf_dir):
    pick = lambda *pairs: F.array_compact(F.array(*[F.when(F.expr(c), x) for c, x in pairs]))
    rows = joined(spark, sf_dir).select(pick(("quality = 0", "low"), ("toxic = 1", "toxic"), ("lang = 'en'", "english")).alias("t"), pick(("n_chars < 900", "low"), ("n_chars % 7 = 0", "toxic"), ("source < 'src15'", "english")).alias("p"))
    return curation.label_report(rows, "t", "p").select("label", "tp", "fp", "fn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query(JOINED + ", s AS (SELECT unnest(list_filter(['all', CASE WHEN n_chars > 1500 THEN 'long' END, CASE WHEN lang = 'en' THEN 'english' END], lambda x: x IS NOT NULL)) AS slice, quality, toxic FROM l) SELECT slice, count(*) AS n, round(avg(CAST(quality = 1 - toxic AS DOUBLE)), 6) AS accuracy FROM s GROUP BY 1")
def eva11_slices(spark, sf_dir):
    names = F.array_compact(F.array(F.lit("all"), F.when(F.col("n_chars") > 1500, "long"), F.when(F.col("lang") == "en", "english")))
    return joined(spark, sf_dir).select(F.explode(names).alias("slice"), "quality", "toxic").groupBy("slice").agg(F.count("*").alias("n"), F.round(F.avg(F.expr("quality = 1 - toxic").cast("double")), 6).alias("accuracy"))


@query("WITH p AS (SELECT event_id, (value % 100) / 100.0 AS a, (value * 3 % 100) / 100.0 AS b FROM events), r AS (SELECT event_id, a + 0.55 * (1 - a) AS raw, b + 0.55 * (1 - b) AS decoded FROM p) SELECT event_id, round(CASE WHEN raw > decoded + 0.03 THEN raw ELSE decoded END, 6) AS risk FROM r")
def eva14_risk_selection(spark, sf_dir):
    a, b = (F.col("value") % 100) / 100.0, (F.col("value") * 3 % 100) / 100.0
    raw, decoded = a + 0.55 * (1 - a), b + 0.55 * (1 - b)
    return docs(spark, sf_dir, "events").select("event_id", F.round(F.when(raw > decoded + 0.03, raw).otherwise(decoded), 6).alias("risk"))


@query(JOINED + ", a AS (SELECT unnest([0.0, 0.5, 1.0, 2.0]) AS alpha), s AS (SELECT alpha, quality, quality = 1 AS base, (n_chars / 2000.0 + alpha * (1 - toxic)) > 0.8 AS tuned FROM l CROSS JOIN a) SELECT alpha, CAST(sum(CAST(NOT base AND tuned = (quality = 1) AS BIGINT)) AS BIGINT) AS fixed, CAST(sum(CAST(base AND tuned <> (quality = 1) AS BIGINT)) AS BIGINT) AS broke FROM s GROUP BY 1")
def eva16_prior_sweep(spark, sf_dir):
    rows = joined(spark, sf_dir).select("quality", "toxic", "n_chars", F.explode(F.array(*map(F.lit, (0.0, 0.5, 1.0, 2.0)))).alias("alpha"))
    right = ((F.col("n_chars") / 2000.0 + F.col("alpha") * (1 - F.col("toxic"))) > 0.8) == (F.col("quality") == 1)
    base = F.col("quality") == 1
    return rows.groupBy("alpha").agg(F.sum((~base & right).cast("long")).alias("fixed"), F.sum((base & ~right).cast("long")).alias("broke"))


@query("SELECT source, count(*) AS n, sha256(string_agg(sha256(text), '' ORDER BY doc_id, sha256(text))) AS digest FROM documents GROUP BY 1")
def snk3_manifest(spark, sf_dir):
    """A digest of each source's texts in the order of their ids."""
    return ordered_digests(docs(spark, sf_dir).select("source", "doc_id", F.sha2("text", 256).alias("h")), "source", "doc_id", "h")


@query("WITH c AS (SELECT doc_id, CASE WHEN toxic = 1 THEN '[\"a\", \"b c\"]' WHEN quality = 0 THEN ' x; y ;;z ' WHEN doc_id % 2 = 0 THEN 'None' ELSE 'solo' END AS cell FROM labels) SELECT doc_id, CASE WHEN cell = 'None' THEN NULL WHEN starts_with(cell, '[') THEN 'a|b c' WHEN cell = 'solo' THEN 'solo' ELSE 'x|y|z' END AS items FROM c")
def src13_snk5_review_cells(spark, sf_dir):
    cell = F.when(F.col("toxic") == 1, '["a", "b c"]').when(F.col("quality") == 0, " x; y ;;z ").when(F.col("doc_id") % 2 == 0, "None").otherwise("solo")
    return docs(spark, sf_dir, "labels").select("doc_id", F.array_join(curation.cell_list(cell), "|").alias("items"))


_PATTERNS = {**weak_labels.CONTEXT, "find_cleanup": weak_labels.FIND_CLEANUP, "clear_operational": weak_labels.OPERATIONAL, "malicious_indicators": weak_labels.INDICATORS}
_WEAK = f"WITH w AS (SELECT event_id, value, command, " + ", ".join(f"regexp_matches(command, '(?i){p}') AS {n}" for n, p in _PATTERNS.items()) + f" FROM ({ADMIN_SQL}))"
_NEEDS = "((" + " OR ".join("(find_root AND NOT find_cleanup)" if n == "find_root" else n for n in weak_labels.CONTEXT) + ") AND NOT (clear_operational AND NOT malicious_indicators))"


@query(_WEAK + f" SELECT event_id, {', '.join(_PATTERNS)} FROM w")
def dst1_predicates(spark, sf_dir):
    found = weak_labels.predicates(F.col("command"))
    return gallery(spark, sf_dir, ADMIN_SQL).select("event_id", *[c.alias(n) for n, c in found.items()])


@query(
    _WEAK + f", l AS (SELECT *, CASE WHEN value < 40 THEN 'Benign' WHEN value < 70 THEN 'Malicious' ELSE 'Context_Dependent' END AS label, CASE WHEN event_id % 3 = 0 THEN 'T1082' ELSE 'T1059' END AS technique FROM w) "
    f"SELECT label AS old_label, CASE WHEN (label = 'Benign' AND {_NEEDS}) OR (label = 'Malicious' AND technique = 'T1082' AND NOT malicious_indicators) THEN 'Context_Dependent' ELSE label END AS new_label, count(*) AS n FROM l GROUP BY 1, 2"
)
def dst1_relabelled(spark, sf_dir):
    label = F.when(F.col("value") < 40, "Benign").when(F.col("value") < 70, "Malicious").otherwise("Context_Dependent")
    technique = F.when(F.col("event_id") % 3 == 0, "T1082").otherwise("T1059")
    rows = gallery(spark, sf_dir, ADMIN_SQL).withColumns({"old_label": label, "technique": technique})
    return rows.withColumn("new_label", weak_labels.relabelled(F.col("command"), F.col("old_label"), F.col("technique"))).groupBy("old_label", "new_label").agg(F.count("*").alias("n"))


@query(_WEAK + f" SELECT event_id, CASE WHEN malicious_indicators THEN 'Malicious' WHEN {_NEEDS} THEN 'Context_Dependent' ELSE 'Benign' END AS label FROM w")
def ml8_rule_baseline(spark, sf_dir):
    return gallery(spark, sf_dir, ADMIN_SQL).select("event_id", weak_labels.rule_baseline(F.col("command")).alias("label"))


_CANON = "regexp_replace(lower(trim(trim({0}), chr(34) || chr(39))), '^[-/]+', '')"
_IS = "(starts_with({0}, '-') OR starts_with({0}, '/'))"
_PLACE = (
    r"CASE WHEN regexp_matches(lower(p), 'windows\\system32|/system32/|\\system32\\|/syswow64/|\\syswow64\\') THEN '<PATH:system32>' WHEN regexp_matches(lower(p), 'users\\public|/public/|\\public\\|programdata|temp|/tmp/') THEN '<PATH:users_public>' "
    r"WHEN regexp_matches(lower(p), '^(c:\\|/|~)') THEN '<PATH:abs>' ELSE '<PATH:relative>' END"
)
_SLOT = (
    r"CASE WHEN regexp_matches(lower(a), '^https?://') THEN '<URL>' WHEN regexp_matches(lower(a), '^(powershell|cmd|python|-encodedcommand|-command)') THEN '<CMD>' ELSE "
    rf"regexp_replace(regexp_replace(regexp_replace(a, '{triage.GUID}', '<GUID>', 'g'), '{triage.HEX}', '<HEX>', 'g'), '\b\d+\b', '<NUM>', 'g') END"
)


#: CTE sg: event_id, exe, sub0, flags and slots of each command.
SIGNATURE = (
    PARSED + f", k AS (SELECT event_id, i, toks[i] AS t, trim(toks[i + 1], chr(34) || chr(39)) AS nx FROM (SELECT event_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM p)), "
    f"cf AS (SELECT event_id, {_CANON.format('t')} AS f, nx FROM k WHERE {_IS.format('t')} AND {_CANON.format('t')} <> ''), uf AS (SELECT event_id, f FROM cf UNION SELECT event_id, f || ':' || {_CANON.format('nx')} FROM cf WHERE nx <> '' AND NOT {_IS.format('nx')}), "
    "fl AS (SELECT event_id, array_to_string(list_sort(list(DISTINCT f)), ',') AS flags FROM uf GROUP BY 1), "
    f"sl AS (SELECT event_id, exe, sub0, array_to_string(list_sort(list_distinct(list_concat(list_transform(paths, lambda p: {_PLACE}), CASE WHEN len(urls) > 0 THEN ['<URL>'] ELSE [] END, CASE WHEN len(ips) > 0 THEN ['<IP>'] ELSE [] END, CASE WHEN len(regs) > 0 THEN ['<REGKEY>'] ELSE [] END, list_transform(args, lambda a: {_SLOT})))), ',') AS slots FROM p), "
    "sg AS (SELECT sl.event_id, exe, coalesce(sub0, '*') AS verb, coalesce(flags, '') AS flags, slots FROM sl LEFT JOIN fl USING (event_id))"
)


@query(SIGNATURE + " SELECT event_id, exe || '|' || verb || '|' || flags || '|' || slots AS raw_signature FROM sg")
def bas1_signature(spark, sf_dir):
    return parsed(spark, sf_dir).select("event_id", triage.signature().alias("s")).select("event_id", "s.raw_signature")
