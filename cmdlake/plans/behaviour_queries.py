"""Queries of behaviour, residual text, priors, evidence and baseline decisions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cmdlake.functions import behaviour, decoding, evidence, routing
from cmdlake.operators import priors
from cmdlake.operators.baseline import allowed_to_bypass, decisions, revoked
from cmdlake.plans.command_queries import _PLAIN, _re
from cmdlake.plans.curation_queries import _TAGS as TAGS_SQL
from cmdlake.plans.dataset_queries import docs
from cmdlake.plans.triage_queries import EFFECTS, ORACLE as TRIAGE, RULED, featured, ruled
from cmdlake.sources.gallery import GALLERY_SQL, gallery

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def routed(df):
    return df.withColumn("f", routing.routing_features(F.col("command"))).select("*", "f.*").drop("f")


def case(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


_STRENGTH = f", rs AS (SELECT * FROM ({TRIAGE['rul0_fired_rules']})), cc AS (SELECT * FROM ({TRIAGE['rul0_candidates']}))"
_VIEWED = RULED + _STRENGTH + ", v AS (SELECT s.*, rs.fired_rules, rs.rule_strength, " + ", ".join(f"{_re(p)} AS {n}" for n, p in _PLAIN.items()) + " FROM s JOIN rs USING (event_id))"
_ACTS = "list_concat([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in behaviour.ACTIONS) + "], list_transform(string_split(fired_rules, ' '), lambda r: " + case("r", behaviour.RULE_ACTIONS) + "))"
_STAGE = "CASE WHEN event_id % 10 = 0 THEN 'Benign Administration' " + " ".join(f"WHEN {' OR '.join(c)} THEN '{n}'" for n, c in behaviour.STAGES) + " WHEN rule_strength <> 'none' THEN 'Execution' ELSE 'Context Required' END"


@query(_VIEWED + f" SELECT event_id, array_to_string(list_sort(list_distinct(list_filter({_ACTS}, lambda a: a IS NOT NULL))), ' ') AS actions, {_STAGE} AS stage FROM v")
def beh1_beh2_actions_stage(spark, sf_dir):
    label = F.when(F.col("event_id") % 10 == 0, "Benign").otherwise("Suspicious")
    rows = ruled(spark, sf_dir, lambda df: routed(df).withColumn("actions", F.array_join(behaviour.action_tags(), " ")))
    return rows.select("event_id", "actions", behaviour.stage(label).alias("stage"))


_TOOLS = behaviour.TOOL_TOKENS
_HIT = lambda parts: "(" + " OR ".join(f"contains(p, '{x}')" for x in parts) + ")"
_BUCKET = "CASE " + " ".join(f"WHEN {_HIT(parts)} THEN '{n}'" for n, parts in behaviour.REGISTRY_BUCKETS) + r" WHEN contains(p, 'classes\') AND regexp_matches(p, 'clsid|progid|shell') THEN 'COM_HIJACK' WHEN contains(p, 'policies\') THEN 'POLICY' ELSE 'GENERAL' END"
_MASKED = "x"
for _n, _p in behaviour.MASKS:
    _MASKED = f"regexp_replace({_MASKED}, '{_p}', ' <{_n}> ', 'g')"
_TOKENS = (
    "list_filter(list_concat([" + case("exe", _TOOLS) + ", coalesce(" + case("exe || ' ' || sub", behaviour.VERB_TOKENS) + ", CASE WHEN sub NOT IN ('', 'exe') THEN upper(sub) END)], list_transform(list_transform(regs, lambda r: replace(lower(r), '/', chr(92))), lambda p: 'REG_' || "
    + _BUCKET + "), [CASE WHEN len(remotes) > 0 OR len(urls) > 0 THEN 'REMOTE_TARGET' END, CASE WHEN len(ips) > 0 THEN 'IP_TARGET' END, CASE WHEN len(domains) > 0 THEN 'DOMAIN_TARGET' END], "
    + "list_distinct(list_transform(paths, lambda p: " + case(r"regexp_extract(lower(p), '(\.[a-z0-9]+)$', 1)", behaviour.SUFFIX_TOKENS) + ")), [CASE WHEN has_pipe THEN 'PIPED' END, CASE WHEN lolbin THEN 'LOLBIN' END, "
    "CASE WHEN len(encs) > 0 THEN 'ENCODED' END, CASE WHEN len(obfs) > 0 THEN 'OBFUSCATED' END, CASE WHEN inline_code THEN 'INLINE_EXEC' END], list_transform(interps, lambda m: 'INTERP_' || upper(m))), lambda t: t IS NOT NULL)"
)
_STRIPPED = rf"trim(regexp_replace({_MASKED}, '\s+', ' ', 'g'))"


@query(RULED + f" SELECT event_id, array_to_string(list_sort(list_distinct({_TOKENS})), ' ') AS tokens, {_STRIPPED} AS body FROM s")
def res3_res4_residual(spark, sf_dir):
    # compared as a sorted set, without the redirect and chain marks, which the PAR queries check
    tokens = F.array_sort(F.array_distinct(F.filter(behaviour.residual_tokens(), lambda t: ~t.isin("REDIRECT", "CHAINED"))))
    return featured(spark, sf_dir).select("event_id", F.array_join(tokens, " ").alias("tokens"), behaviour.masked(F.col("text")).alias("body"))


@query(
    RULED + _STRENGTH + f" SELECT s.event_id, array_to_string({TAGS_SQL}, ' ') AS tags, "
    "array_to_string(list_sort(list_transform(list_filter(string_split(cc.candidates, ' '), lambda c: c <> ''), lambda c: 'RULE:' || string_split(c, ':')[-1])), ' ') AS rule_tags FROM s JOIN cc USING (event_id)"
)
def res5_beh4_feature_list(spark, sf_dir):
    f = ruled(spark, sf_dir).select("event_id", behaviour.feature_list().alias("f"))
    rule = lambda t: t.startswith("RULE:")
    return f.select("event_id", F.array_join(F.filter("f", lambda t: ~rule(t)), " ").alias("tags"), F.array_join(F.array_sort(F.filter("f", rule)), " ").alias("rule_tags"))


@query(
    "WITH r AS (SELECT doc_id, 'TRANSFER | ' || text AS residual, CASE WHEN doc_id % 2 = 0 THEN 'FEATURES: ENUM_IDENTITY RULE:x' END AS f, text FROM documents) "
    "SELECT doc_id, sha256('RAW: ' || text || chr(10) || 'RESIDUAL: ' || residual || CASE WHEN f IS NULL THEN '' ELSE chr(10) || f END) AS input_a, sha256('RESIDUAL: ' || residual || CASE WHEN f IS NULL THEN '' ELSE chr(10) || f END) AS input_b, sha256(residual) AS input_c FROM r"
)
def snk6_text_variants(spark, sf_dir):
    tags = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("ENUM_IDENTITY"), F.lit("RULE:x"))).otherwise(F.array().cast("array<string>"))
    rows = docs(spark, sf_dir).withColumns({"residual": F.concat(F.lit("TRANSFER | "), "text"), "feature_list": tags})
    return rows.select("doc_id", behaviour.model_texts().alias("t")).select("doc_id", *[F.sha2(f"t.{n}", 256).alias(n) for n in ("input_a", "input_b", "input_c")])


@query(
    RULED + _STRENGTH + f" SELECT exe AS command_group, CASE WHEN {' OR '.join(behaviour.HIGH_SIGNAL)} OR rule_strength = 'strong' THEN 'high_signal' WHEN rule_strength = 'weak' OR {' OR '.join(behaviour.IN_CONTEXT)} THEN 'context_dependent' ELSE 'routine_candidate' END AS bucket, count(*) AS n "
    "FROM s JOIN rs USING (event_id) GROUP BY 1, 2"
)
def res7_intent_matrix(spark, sf_dir):
    rows = ruled(spark, sf_dir).select(F.col("executable").alias("command_group"), behaviour.intent_bucket().alias("bucket"))
    return rows.groupBy("command_group", "bucket").agg(F.count("*").alias("n"))


_TECH = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in behaviour.TACTIC_STAGE.items()) + ") t(tactic, stage)"
_WEAK = (
    "WITH d AS (SELECT doc_id, source, 'T1' || lpad(CAST(100 + doc_id % 9 AS VARCHAR), 3, '0') AS technique, CASE doc_id % 4 WHEN 0 THEN ['RULE:exfiltration', 'PIPE'] WHEN 1 THEN ['INLINE_EXEC', 'RULE:remote_services', 'PIPE'] ELSE [] END AS feats, "
    "CASE WHEN doc_id % 4 = 2 THEN 'credential_dumping' END AS rule, (ARRAY['Reconnaissance', 'Discovery', 'Impact', 'Nothing', 'Collection'])[1 + doc_id % 5] AS tactic FROM documents) "
)


@query(
    _WEAK + f"SELECT doc_id, CASE WHEN technique = 'T1105' THEN 'Payload Retrieval' WHEN doc_id % 4 = 0 THEN 'Exfiltration' WHEN doc_id % 4 = 2 THEN 'Credential Access' ELSE coalesce(t.stage, 'Context Required') END AS stage, "
    f"CASE doc_id % 4 WHEN 0 THEN 'pipe_data' WHEN 1 THEN 'execute_inline_code pipe_data remote_execution' ELSE '' END AS actions FROM d LEFT JOIN {_TECH} USING (tactic)"
)
def beh3_weak_behaviour(spark, sf_dir):
    k = F.col("doc_id") % 4
    words = lambda *w: F.array(*map(F.lit, w)).cast("array<string>")
    rows = docs(spark, sf_dir).withColumns({
        "feature_list": F.when(k == 0, words("RULE:exfiltration", "PIPE")).when(k == 1, words("INLINE_EXEC", "RULE:remote_services", "PIPE")).otherwise(words()),
        "fired_rules": F.when(k == 2, words("_rule_credential_dumping")).otherwise(words()),
    })
    tactic = F.element_at(words("Reconnaissance", "Discovery", "Impact", "Nothing", "Collection"), (F.col("doc_id") % 5 + 1).cast("int"))
    technique = F.concat(F.lit("T1"), F.lpad((F.col("doc_id") % 9 + 100).cast("string"), 3, "0"))
    return rows.select("doc_id", behaviour.weak_stage(technique, tactic).alias("stage"), F.array_join(behaviour.weak_actions(), " ").alias("actions"))


@query(
    "WITH p AS (SELECT vec_id, i - 1 AS i, round(100 / (1 + exp(-CAST(v AS DOUBLE))), 2) AS p, 1 / (1 + exp(-CAST(v AS DOUBLE))) >= 0.52 AS chosen FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS v FROM embeddings)) "
    "SELECT vec_id, coalesce(string_agg('F' || lpad(CAST(i AS VARCHAR), 3, '0'), ' ' ORDER BY p DESC, i) FILTER (chosen), '') AS families, count(*) FILTER (chosen) AS n FROM p GROUP BY 1"
)
def fam1_family_scores(spark, sf_dir):
    rows = docs(spark, sf_dir, "embeddings")
    # as many families as a vector has components, which is a property of the schema's data, not of its rows
    width = rows.select(F.max(F.size("embedding"))).first()[0] or 0
    p = F.transform("embedding", lambda v: 1 / (1 + F.exp(-v.cast("double"))))
    chosen = behaviour.family_scores(p, [f"F{i:03d}" for i in range(width)], 0.52)["selected"]
    return rows.select("vec_id", F.array_join(F.transform(chosen, lambda s: s["family"]), " ").alias("families"), F.size(chosen).cast("long").alias("n"))


SPACE = sorted({t for table in (priors.TECHNIQUES, priors.TACTICS) for names in table.values() for t in names})
_pairs = lambda table, name: f"{name} AS (SELECT a, unnest(string_split(b, ' ')) AS b FROM (VALUES " + ", ".join(f"('{k}', '{' '.join(v)}')" for k, v in table.items()) + ") t(a, b))"
_TABLES = ", " + ", ".join(_pairs(t, n) for t, n in ((priors.TECHNIQUES, "tec"), (priors.NEIGHBOURS, "nbr"), (priors.TACTICS, "tac"), (priors.ADJACENT, "adj"))) + ", sp AS (SELECT DISTINCT b FROM (SELECT b FROM tec UNION ALL SELECT b FROM tac))"


@query(
    EFFECTS + _TABLES + f", rs AS (SELECT * FROM ({TRIAGE['rul0_fired_rules']})), pr AS (SELECT event_id, class, least(1.0, sum(w)) AS prior FROM ef WHERE w > 0 GROUP BY 1, 2) "
    "SELECT event_id, tec.b AS technique, round(max(prior) * CASE rule_strength WHEN 'strong' THEN 2.0 ELSE 1.5 END, 6) AS prior FROM pr JOIN tec ON tec.a = class JOIN rs USING (event_id) GROUP BY event_id, tec.b, rule_strength"
)
def pri1_pri2_prior_vector(spark, sf_dir):
    vector = priors.prior_vector(F.col("priors"), F.col("rule_strength"), SPACE)
    given = lambda df: df.select("command", F.posexplode_outer(vector).alias("i", "prior")).filter("prior > 0")
    each = ruled(spark, sf_dir, given)
    return each.select("event_id", F.element_at(F.array(*map(F.lit, SPACE)), F.col("i") + 1).alias("technique"), F.round("prior", 6).alias("prior"))


_MASK_SQL = (
    RULED + _STRENGTH + _TABLES + ", nom AS (SELECT event_id, unnest(string_split(candidates, ' ')) AS class FROM cc WHERE candidates <> ''), "
    "bn AS (SELECT event_id, tec.b FROM s, tec WHERE deletes_shadow_copies AND tec.a IN ('command_and_control:ingress_tool_transfer', 'persistence:registry_run_key', 'persistence:scheduled_task')), "
    "n0 AS (SELECT DISTINCT event_id, tec.b FROM nom JOIN tec ON tec.a = class EXCEPT SELECT * FROM bn), n1 AS (SELECT DISTINCT event_id, nbr.b FROM n0 JOIN nbr ON nbr.a = n0.b SEMI JOIN sp ON sp.b = nbr.b EXCEPT SELECT * FROM bn), "
    "n2 AS (SELECT DISTINCT n1.event_id, nbr.b FROM n1 JOIN nbr ON nbr.a = n1.b JOIN rs USING (event_id) SEMI JOIN sp ON sp.b = nbr.b WHERE rule_strength = 'weak'), t0 AS (SELECT DISTINCT event_id, string_split(class, ':')[1] AS tactic FROM nom), "
    "t1 AS (SELECT * FROM t0 UNION SELECT t0.event_id, adj.b FROM t0 JOIN adj ON adj.a = tactic JOIN rs USING (event_id) WHERE rule_strength = 'weak'), "
    "al AS (SELECT * FROM n0 UNION SELECT * FROM n1 UNION SELECT * FROM n2 UNION SELECT t1.event_id, tac.b FROM t1 JOIN tac ON tac.a = tactic SEMI JOIN n0 ON n0.event_id = t1.event_id), ok AS (SELECT * FROM al EXCEPT SELECT * FROM bn), "
    "fb AS (SELECT s.event_id, rule_strength = 'none' OR s.event_id NOT IN (SELECT event_id FROM n0) AS fallback FROM s JOIN rs USING (event_id)), "
    "fin AS (SELECT ok.* FROM ok JOIN fb USING (event_id) WHERE NOT fallback UNION ALL SELECT event_id, sp.b FROM fb, sp WHERE fallback), "
    f"tr AS (SELECT event_id, {SPACE!r}[1 + event_id % {len(SPACE)}] AS truth FROM s), z AS (SELECT event_id, any_value(fallback) AS fallback, bool_or(fin.b = truth) AS organic, count(*) AS n, string_agg(fin.b, ' ' ORDER BY fin.b) AS candidates FROM fin JOIN fb USING (event_id) JOIN tr USING (event_id) GROUP BY 1)"
)


def candidates(spark, sf_dir):
    truth = F.element_at(F.array(*map(F.lit, SPACE)), (F.col("event_id") % len(SPACE) + 1).cast("int"))
    return priors.with_mask(ruled(spark, sf_dir, lambda df: priors.open_candidates(df, SPACE)).withColumn("truth", truth), SPACE, "truth")


@query(_MASK_SQL + " SELECT event_id, candidates, fallback AS used_fallback, organic, CAST(n + CASE WHEN organic THEN 0 ELSE 1 END AS INTEGER) AS num_candidates FROM z")
def pri3_candidate_mask(spark, sf_dir):
    return candidates(spark, sf_dir).select("event_id", F.array_join("candidates", " ").alias("candidates"), "used_fallback", "organic", "num_candidates")


@query(
    _MASK_SQL + ", q AS (SELECT organic, fallback, n + CASE WHEN organic THEN 0 ELSE 1 END AS n FROM z) SELECT count(*) AS total, count(*) FILTER (organic) AS organic, round(count(*) FILTER (organic) / count(*) * 100, 2) AS organic_pct, count(*) FILTER (fallback) AS fallback, "
    "round(count(*) FILTER (fallback) / count(*) * 100, 2) AS fallback_pct, round(sum(n) / count(*), 2) AS mean_size, CAST(min(n) AS INTEGER) AS min_size, CAST(max(n) AS INTEGER) AS max_size, CAST(list_sort(list(n))[1 + count(*) // 2] AS INTEGER) AS median_size FROM q"
)
def pri5_coverage(spark, sf_dir):
    return priors.coverage(candidates(spark, sf_dir))


@query(
    "WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), m AS (SELECT vec_id, i, v * CASE WHEN (vec_id + i) % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN (vec_id + i) % 3 = 0 THEN -1e9 ELSE 0 END AS m, v + 2.0 * (i % 4) / 10 AS f FROM e) "
    "SELECT vec_id, arg_max(i, m) AS masked_best, arg_max(i, f) AS fused_best, round(max(f), 6) AS fused_score, count(*) FILTER (m < -1e8) AS closed FROM m GROUP BY 1"
)
def pri4_masked_and_fused(spark, sf_dir):
    scores = F.transform("embedding", lambda v: v.cast("double"))
    mask = F.transform("embedding", lambda v, i: ((F.col("vec_id") + i) % 3 != 0).cast("int"))
    prior = F.transform("embedding", lambda v, i: (i % 4) / F.lit(10.0))
    rows = docs(spark, sf_dir, "embeddings").select("vec_id", priors.masked_scores(scores, mask).alias("m"), priors.fused_scores(scores, prior, 2.0).alias("f"))
    best = lambda a: (F.array_position(a, F.array_max(a)) - 1).cast("long")
    return rows.select("vec_id", best(F.col("m")).alias("masked_best"), best(F.col("f")).alias("fused_best"), F.round(F.array_max("f"), 6).alias("fused_score"), F.size(F.filter("m", lambda x: x < -1e8)).cast("long").alias("closed"))


_V6 = "'from [2001:DB8:0:0:0:0:' || upper(to_hex(event_id % 65000 + 1)) || ':1] to ::ffff and 12:30:45 ' || command"


@query(f"SELECT event_id, '2001:db8::' || lower(to_hex(event_id % 65000 + 1)) || ':1 ::ffff' AS addresses FROM ({GALLERY_SQL})")
def ioc2_ipv6(spark, sf_dir):
    text = F.concat(F.lit("from [2001:DB8:0:0:0:0:"), F.hex(F.col("event_id") % 65000 + 1), F.lit(":1] to ::ffff and 12:30:45 "), "command")
    return gallery(spark, sf_dir).select("event_id", F.array_join(evidence.ipv6(text), " ").alias("addresses"))


_URLS = r"list_distinct(regexp_extract_all(text, '(?i)\b(?:https?|ftp)://[^\s\x22\x27<>|]+'))"
_TEXTS = "t AS (SELECT page_id AS id, url || ' ' || html || ' ' || replace(url, 'http', 'hxxp') || ' ' || md5(url) AS text FROM pages)"


@query(
    f"WITH {_TEXTS}, u AS (SELECT id, text, unnest({_URLS}) AS url FROM t), h AS (SELECT DISTINCT id, text, lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/@?#]*@)?([^/:?#]+)', 1)) AS host FROM u), "
    r"x AS (SELECT id, text, 'url' AS type, url AS value FROM u UNION SELECT id, text, CASE WHEN regexp_matches(host, '^(\d{1,3}\.){3}\d{1,3}$') THEN 'ip' ELSE 'domain' END, host FROM h WHERE host <> '' "
    r"UNION SELECT id, text, 'hash', lower(unnest(regexp_extract_all(text, '\b(?:[A-Fa-f0-9]{64}|[A-Fa-f0-9]{40}|[A-Fa-f0-9]{32})\b'))) FROM t "
    r"UNION SELECT id, text, 'defanged_url', replace(replace(regexp_replace(regexp_replace(d, '[;,.!)]+$', ''), '\[\.\]', '.', 'g'), 'hxxps', 'https'), 'hxxp', 'http') FROM (SELECT id, text, unnest(regexp_extract_all(text, '(?i)\bhxxps?://[^\s\x22\x27<>|]+')) AS d FROM t)) "
    "SELECT type, count(*) AS n, count(DISTINCT value) AS n_values, count(*) FILTER (position(lower(value) IN lower(text)) > 0) AS observed, CAST(sum(position(lower(value) IN lower(text))) AS BIGINT) AS places FROM x GROUP BY 1"
)
def ioc4_indicator_records(spark, sf_dir):
    text = F.concat_ws(" ", "url", "html", F.replace("url", F.lit("http"), F.lit("hxxp")), F.md5("url"))
    found = evidence.indicator_records(docs(spark, sf_dir, "pages").select("page_id", text.alias("text")), "page_id")
    return found.groupBy("type").agg(
        F.count("*").alias("n"), F.countDistinct("value").alias("n_values"), F.sum((F.col("confidence") == "observed").cast("long")).alias("observed"), F.sum((F.coalesce("span_start", F.lit(-1)) + 1).cast("long")).alias("places"),
    )


_TWICE = "to_base64(encode(to_base64(encode(command))))"


@query(
    f"WITH g AS (SELECT * FROM ({GALLERY_SQL}) WHERE regexp_matches(command, '^[ -~]*$') AND length(command) > 7 AND NOT regexp_matches(command, '(?i)\\[char\\]|base64|-enc|\\x22')) "
    f"SELECT event_id, 'raw' AS source_view, sha256({_TWICE}) AS digest FROM g UNION ALL SELECT event_id, 'layer_1', sha256(to_base64(encode(command))) FROM g UNION ALL SELECT event_id, 'decoded', sha256(command) FROM g"
)
def ioc5_dec12_views(spark, sf_dir):
    pack = lambda c: F.regexp_replace(F.base64(F.encode(c, "utf-8")), r"\s", "")
    plain = F.col("command").rlike(r"^[ -~]*$") & (F.length("command") > 7) & ~F.col("command").rlike(r"(?i)\[char\]|base64|-enc|\x22")
    packed = gallery(spark, sf_dir).filter(plain).select("event_id", pack(pack(F.col("command"))).alias("command"))
    return evidence.views(decoding.decode(packed), "event_id").select("event_id", "source_view", F.sha2("text", 256).alias("digest"))


@query("SELECT p_partkey, CASE WHEN length(p_name) >= 4 THEN p_name END AS decoded FROM part")
def dec3_dec6_native_base64(spark, sf_dir):
    packed = F.regexp_replace(F.base64(F.encode("p_name", "utf-8")), r"\s", "")
    return docs(spark, sf_dir, "part").select("p_partkey", decoding.base64_text(packed).alias("decoded"))


@query(f"SELECT event_id, command AS decoded, TRUE AS was_obfuscated FROM ({GALLERY_SQL}) WHERE regexp_matches(command, '^[ -~]*$') AND length(command) > 7 AND NOT regexp_matches(command, '(?i)\\[char\\]|base64|-enc|\\x22')")
def dec13_older_stop_rule(spark, sf_dir):
    plain = F.col("command").rlike(r"^[ -~]*$") & (F.length("command") > 7) & ~F.col("command").rlike(r"(?i)\[char\]|base64|-enc|\x22")
    packed = gallery(spark, sf_dir).filter(plain).select("event_id", F.regexp_replace(F.base64(F.encode("command", "utf-8")), r"\s", "").alias("command"))
    return decoding.decode(packed, stop="entropy_delta").select("event_id", F.col("decode.final").alias("decoded"), "decode.was_obfuscated")


_ARTEFACT = "CASE WHEN len(regs) > 0 THEN 'registry' WHEN creates_scheduled_task THEN 'task' WHEN creates_or_modifies_service THEN 'service' WHEN archive_create OR archive_extract THEN 'archive' WHEN len(urls) > 0 OR len(remotes) > 0 OR downloads_remote_resource THEN 'network' WHEN runs_interpreter OR executes_inline_code THEN 'script' WHEN len(paths) > 0 THEN 'file' END"
_STYLE = "CASE WHEN downloads_remote_resource AND (executes_inline_code OR has_pipe) THEN 'download-and-execute' WHEN creates_scheduled_task THEN 'scheduled' WHEN remote_execution_or_session THEN 'remote-session' WHEN executes_inline_code OR inline_code THEN 'inline' WHEN downloads_remote_resource THEN 'download-and-execute' END"


@query(RULED + f" SELECT event_id, {_ARTEFACT} AS artefact, {_STYLE} AS style, array_to_string(list_sort(list_distinct(list_filter(list_transform(flags, lambda f: lower(f)), lambda f: list_contains({evidence.FLAGS!r}, f)))), ' ') AS high_signal_flags FROM s")
def ioc7_evidence(spark, sf_dir):
    return featured(spark, sf_dir).select("event_id", evidence.artefact().alias("artefact"), evidence.style().alias("style"), F.array_join(evidence.high_signal_flags(), " ").alias("high_signal_flags"))


@query(RULED + " SELECT event_id, platform, len(urls) AS urls, len(ips) AS ips, len(ports) AS ports FROM s")
def rte8_ioc9_projection(spark, sf_dir):
    picked = evidence.project_results(featured(spark, sf_dir), ["platform", "iocs"], ["urls", "ips", "ports"], ("event_id",))
    return picked.select("event_id", "platform", *[F.size(f"iocs.{n}").cast("long").alias(n) for n in ("urls", "ips", "ports")])


_STATS = "WITH k AS (SELECT user_id, user_id % 7 AS role, event_type, ts FROM events), st AS (SELECT 'host' AS level, user_id AS scope, event_type, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days, 1 AS hosts FROM k GROUP BY ALL UNION ALL SELECT 'role', role, event_type, count(*), count(DISTINCT CAST(ts AS DATE)), count(DISTINCT user_id) FROM k GROUP BY ALL UNION ALL SELECT 'fleet', 0, event_type, count(*), count(DISTINCT CAST(ts AS DATE)), count(DISTINCT user_id) FROM k GROUP BY ALL), "


@query(
    _STATS + "pr AS (SELECT *, n >= 5 AND days >= 3 AND NOT (event_type = 'view' AND scope % 3 = 0) AS promoted FROM st), b AS (SELECT level, scope, event_type, CASE level WHEN 'host' THEN promoted WHEN 'role' THEN promoted AND hosts >= 2 ELSE false END AS bypass FROM pr) "
    "SELECT *, NOT bypass AS run_enforced, TRUE AS run_audited, CASE WHEN bypass THEN 'known_stable' ELSE 'learning' END AS status_learning, CASE WHEN bypass THEN 'known_stable' ELSE 'rare_or_novel' END AS status FROM b"
)
def bas8_bas10_decisions(spark, sf_dir):
    # the learning mode, too, lets what it knows as stable bypass; only its status for the rest differs
    k = docs(spark, sf_dir, "events").select(F.col("user_id").alias("host"), (F.col("user_id") % 7).alias("role"), "event_type", "ts")
    stats = lambda level, scope: k.groupBy(F.lit(level).alias("level"), scope.cast("long").alias("scope"), "event_type").agg(F.count("*").alias("n"), F.countDistinct(F.to_date("ts")).alias("days"), F.countDistinct("host").alias("hosts"))
    known = stats("host", F.col("host")).unionByName(stats("role", F.col("role"))).unionByName(stats("fleet", F.lit(0)))
    gone = known.filter("event_type = 'view' and scope % 3 = 0").select("level", "scope", "event_type")
    rows = revoked(known.withColumn("promoted", F.expr("n >= 5 and days >= 3")), gone, ["level", "scope", "event_type"])
    free = rows.withColumn("bypass", allowed_to_bypass(F.col("level"), F.col("promoted"), F.lit("r"), F.col("hosts")))
    status, enforced = decisions(F.col("bypass"), "enforce")
    return free.select("level", "scope", "event_type", "bypass", enforced.alias("run_enforced"), decisions(F.col("bypass"), "audit")[1].alias("run_audited"), decisions(F.col("bypass"), "learn")[0].alias("status_learning"), status.alias("status"))
