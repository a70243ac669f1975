"""Queries over the commands table: text, parsing, indicators, baseline."""

from __future__ import annotations

from pyspark.sql import functions as F

from cmdlake.functions import decoding, parsing, routing, text
from cmdlake.operators import baseline
from cmdlake.sources.commands import COMMANDS_SQL, commands, execution_contexts, history_command, last_comma

QUERIES, ORACLE = {}, {}
WITH = f"WITH commands AS ({COMMANDS_SQL})"
#: DuckDB forms of the shared normal forms.
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
COLLAPSE = rf"regexp_replace({STRIP}, '\s+', ' ', 'g')"
TEXT = COLLAPSE.format("command")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def docs(spark, sf_dir, name="documents"):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parsed(spark, sf_dir):
    return commands(spark, sf_dir).withColumn("p", parsing.parse(F.col("command"), quotes=False))


def arr(c, name):
    return F.array_join(c, "\x1f").alias(name)


@query(rf"SELECT doc_id, lower({STRIP.format('text')}) AS match_key FROM documents")
def n1_match_key(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.match_key(F.col("text")).alias("match_key"))


@query(rf"SELECT doc_id, {COLLAPSE.format('text')} AS collapsed, lower({COLLAPSE.format('text')}) AS dedup_key FROM documents")
def n2_n3_normal_forms(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.collapse(F.col("text")).alias("collapsed"), text.dedup_key(F.col("text")).alias("dedup_key"))


@query(WITH + rf" SELECT 'tool:' || lower(split_part({TEXT}, ' ', 1)) AS family, count(*) AS n FROM commands GROUP BY 1")
def n6_tool_family(spark, sf_dir):
    return commands(spark, sf_dir).groupBy(text.tool_family(F.col("command")).alias("family")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(text) AS command_id FROM documents")
def n8_command_id(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.command_id(F.col("text")).alias("command_id"))


@query(
    "SELECT doc_id, CASE WHEN toxic = 1 OR quality = 0 THEN 'Context' ELSE 'Benign' END AS label, "
    "CASE WHEN toxic = 1 THEN 'Suspicious' WHEN quality = 0 THEN 'Context_Dependent' ELSE 'Benign' END AS public_label, "
    "CASE WHEN toxic = 1 OR quality = 0 THEN 'requires_context' ELSE 'pass' END AS action FROM labels"
)
def n9_n10_label_maps(spark, sf_dir):
    raw = F.when(F.col("toxic") == 1, "Malicious").when(F.col("quality") == 0, "Suspicious").otherwise("Benign")
    two = F.when(F.col("raw").isin("Malicious", "Suspicious", "Context"), "Context").when(F.col("raw") == "Benign", "Benign").otherwise(F.raise_error(F.lit("unknown label")))
    public = F.when(F.col("raw") == "Malicious", "Suspicious").when(F.col("raw") == "Suspicious", "Context_Dependent").otherwise(F.col("raw"))
    act = F.when(F.col("raw") == "Benign", "pass").otherwise("requires_context")
    return docs(spark, sf_dir, "labels").withColumn("raw", raw).select("doc_id", two.alias("label"), public.alias("public_label"), act.alias("action"))


def _redact_sql(column: str) -> str:
    import re

    for pattern, new in text.redactions():
        column = f"regexp_replace({column}, '{pattern.replace(chr(39), chr(39) * 2)}', '{re.sub(r'[$]([0-9])', chr(92) + chr(92) + '1', new).replace(chr(92) * 2, chr(92))}', 'g')"
    return column


@query(WITH + f", r AS (SELECT event_id, command, {_redact_sql('command')} AS redacted FROM commands) SELECT event_id, redacted, redacted <> command AS changed FROM r")
def n14_redaction(spark, sf_dir):
    return commands(spark, sf_dir).withColumn("redacted", text.redact(F.col("command"))).select("event_id", "redacted", (F.col("redacted") != F.col("command")).alias("changed"))


@query(WITH + f", r AS (SELECT role, command, {_redact_sql('command')} AS redacted FROM commands) SELECT role, count(*) AS n_lines, CAST(sum(CAST(redacted <> command AS INTEGER)) AS BIGINT) AS n_changed FROM r GROUP BY 1")
def n14_changed_lines(spark, sf_dir):
    return text.changed_lines(commands(spark, sf_dir), "command", "role")


_ISO = "'2024-03-0' || CAST(1 + event_id % 9 AS STRING) || 'T1' || CAST(event_id % 10 AS STRING) || ':30:00' || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Z' ELSE '+02:00' END"
_GIVEN = (
    f"SELECT event_id, CASE WHEN user_id % 11 > 0 THEN 'H' || CAST(user_id AS STRING) END AS host_id, CASE WHEN event_id % 5 > 0 THEN '  ' || upper(event_type) || ' ' END AS parent_process, "
    f"CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' Admin ' WHEN 2 THEN 'dev' END AS role, CASE WHEN user_id % 2 = 0 THEN ' EU ' END AS fleet, CASE WHEN event_id % 6 < 3 THEN event_id % 6 = 0 END AS in_maintenance_window, {_ISO} AS timestamp FROM events"
)


@query(
    f"WITH g AS ({_GIVEN}) SELECT event_id, coalesce(host_id, 'unknown') AS host_id, coalesce(lower(trim(parent_process)), 'unknown') AS parent_process, 'unknown' AS user, CASE WHEN role <> '' THEN lower(trim(role)) END AS role, coalesce(lower(trim(fleet)), 'default') AS fleet, coalesce(in_maintenance_window, false) AS in_maintenance_window, "
    "epoch_us(CAST(substr(timestamp, 1, 19) AS TIMESTAMP)) - CASE event_id % 3 WHEN 2 THEN 7200000000 ELSE 0 END AS micros FROM g"
)
def src14_contexts(spark, sf_dir):
    given = spark.sql(_GIVEN.replace("FROM events", "FROM {events}"), events=docs(spark, sf_dir, "events"))
    whole = execution_contexts(given)
    return whole.select("event_id", "host_id", "parent_process", "user", "role", "fleet", "in_maintenance_window", F.unix_micros("timestamp").alias("micros"))


@query(
    "WITH lines AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations), "
    r"bare AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(line, '^\s*:\s*\d+:\d+;', ''), '^\s*\d+\*?\s+', ''), '^\s+|\s+$', '', 'g') AS command FROM lines) "
    "SELECT conv_id, turn, command FROM bare WHERE command <> '' AND NOT starts_with(command, '#')"
)
def src3_history_lines(spark, sf_dir):
    lines = docs(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("conv_id", "turn", history_command(F.col("line")).alias("command")).filter("command is not null")


@query(r"SELECT p_partkey, regexp_extract(p_name || ',x,' || p_type, '(?s)^(.*),([^,]*)$', 1) AS command, regexp_extract(p_name || ',x,' || p_type, '(?s)^(.*),([^,]*)$', 2) AS label FROM part")
def src2_last_comma(spark, sf_dir):
    line = F.concat_ws(",", "p_name", F.lit("x"), "p_type")
    return docs(spark, sf_dir, "part").select("p_partkey", last_comma(line).alias("x")).select("p_partkey", "x.*")


@query(
    WITH + ", chars AS (SELECT event_id, length(command) AS n, unnest(string_split(command, '')) AS c FROM commands), "
    "cells AS (SELECT event_id, n, c, count(*) AS k FROM chars GROUP BY 1, 2, 3) "
    "SELECT event_id, round(-sum(k * 1.0 / n * log2(k * 1.0 / n)), 6) AS entropy FROM cells GROUP BY 1"
)
def dec1_entropy(spark, sf_dir):
    return commands(spark, sf_dir).select("event_id", F.round(text.entropy(F.col("command")), 6).alias("entropy"))


@query(
    WITH + rf", t AS (SELECT event_id, {TEXT} AS x FROM commands) SELECT event_id, "
    r"len(list_filter(regexp_extract_all(x, '\|+'), lambda y: y = '|')) AS n_pipes, len(regexp_extract_all(x, '2>>|2>|1>>|1>|>>|<<|>|<')) AS n_redirects, "
    r"array_to_string(regexp_extract_all(x, '&&|\|\||;'), ' ') AS chains FROM t"
)
def par2_operators(spark, sf_dir):
    p = parsed(spark, sf_dir)
    return p.select("event_id", F.size("p.pipe_operators").cast("long").alias("n_pipes"), F.size("p.redirect_operators").cast("long").alias("n_redirects"), F.array_join("p.chain_operators", " ").alias("chains"))


@query(
    r"SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '(?i)\b(?:https?|ftp)://[^\s\x22\x27<>|]+'))), ' ') AS urls, "
    r"len(list_distinct(list_filter(regexp_extract_all(html, ':(\d{1,5})(?:\b|/)', 1), lambda p: CAST(p AS INTEGER) BETWEEN 1 AND 65535))) AS n_ports FROM pages"
)
def par7_par10_urls_ports(spark, sf_dir):
    c = F.col("html")
    return docs(spark, sf_dir, "pages").select(
        "page_id", F.array_join(F.array_sort(F.array_distinct(parsing.all_of(c, parsing.URL))), " ").alias("urls"),
        F.size(F.array_distinct(F.filter(parsing.all_of(c, parsing.PORT, 1), lambda x: x.cast("int").between(1, 65535)))).cast("long").alias("n_ports"),
    )


@query(
    r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b'), "
    r"lambda ip: len(list_filter(string_split(ip, '.'), lambda o: CAST(o AS INTEGER) <= 255 AND (o = '0' OR NOT starts_with(o, '0')))) = 4))), ' ') AS ips FROM documents"
)
def par8_ips(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(parsing.valid_ips(F.col("text"))), " ").alias("ips"))


@query(
    "SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(text, '[^A-Fa-f0-9]+'), lambda x: len(x) IN (32, 40, 64)), lambda x: lower(x)))), ' ') AS hashes FROM documents"
)
def ioc1_hashes(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(text.hash_indicators(F.col("text"))), " ").alias("hashes"))


@query(
    WITH + r", x AS (SELECT host_id, unnest(regexp_extract_all(command, '\b(?:\d{1,3}\.){3}\d{1,3}\b')) AS value FROM commands) "
    "SELECT value, count(*) AS n_commands, count(DISTINCT host_id) AS n_hosts FROM x GROUP BY 1"
)
def ioc10_prevalence(spark, sf_dir):
    rows = commands(spark, sf_dir).select("host_id", F.explode(parsing.valid_ips(F.col("command"))).alias("value"))
    return rows.groupBy("value").agg(F.count("*").alias("n_commands"), F.countDistinct("host_id").alias("n_hosts"))


SIGNED = WITH + f", s AS (SELECT *, lower({TEXT}) AS signature, (value % 100) / 500.0 AS probability FROM commands)"


def signed(spark, sf_dir):
    return commands(spark, sf_dir).withColumns({"signature": text.dedup_key(F.col("command")), "probability": (F.col("value") % 100) / 500.0})


_LEVELS = (
    ", l AS (SELECT 'host' AS level, 'host:' || host_id AS scope_id, * FROM s UNION ALL SELECT 'role', 'role:' || role, * FROM s UNION ALL SELECT 'fleet', 'fleet:default', * FROM s) "
)


@query(
    SIGNED + _LEVELS + "SELECT level, scope_id, signature, count(*) AS seen_count, min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT CAST(ts AS DATE)) AS distinct_days, "
    "count(DISTINCT host_id) AS hosts_observed, count(DISTINCT parent_process) AS parents FROM l GROUP BY 1, 2, 3"
)
def bas3_sightings(spark, sf_dir):
    return baseline.sightings(signed(spark, sf_dir))


@query(
    SIGNED + _LEVELS + ", t AS (SELECT level, scope_id, count(*) AS total FROM l GROUP BY 1, 2), k AS (SELECT level, scope_id, signature, count(*) AS n FROM l GROUP BY 1, 2, 3) "
    "SELECT level, scope_id, signature, round(-log2((n + 0.5) / (total + 50.0)), 6) AS surprise FROM k JOIN t USING (level, scope_id)"
)
def bas5_surprise(spark, sf_dir):
    s = signed(spark, sf_dir)
    keys = baseline.scoped(s).groupBy("level", "scope_id", "signature").agg(F.count("*").alias("n"))
    return keys.join(baseline.totals(s), ["level", "scope_id"]).select("level", "scope_id", "signature", F.round(baseline.surprise(F.col("n"), F.col("total")), 6).alias("surprise"))


@query(
    SIGNED + ", d AS (SELECT *, CAST(row_number() OVER (PARTITION BY host_id, signature, CAST(ts AS DATE) ORDER BY ts, event_id) = 1 AS BIGINT) AS new_day FROM s), "
    "e AS (SELECT *, count(*) OVER b AS seen_before, sum(new_day) OVER u AS days, sum(CAST(probability >= 0.15 AS BIGINT)) OVER u AS flags, "
    "row_number() OVER (PARTITION BY host_id, signature, parent_process ORDER BY ts, event_id) = 1 AS lineage_novel, count(*) OVER h AS host_before FROM d "
    "WINDOW b AS (PARTITION BY host_id, signature ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u AS (PARTITION BY host_id, signature ORDER BY ts, event_id), "
    "h AS (PARTITION BY host_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "g AS (SELECT *, seen_before + 1 >= 5 AND days >= 3 AND flags = 0 AS promoted FROM e) "
    "SELECT event_id, seen_before, lineage_novel, CASE WHEN seen_before > 0 THEN round(-log2((seen_before + 0.5) / (host_before + 50.0)), 3) END AS surprise_full, promoted AS promoted_upto, "
    "coalesce(lag(promoted) OVER (PARTITION BY host_id, signature ORDER BY ts, event_id), false) AND NOT lineage_novel AS known_stable FROM g"
)
def bas6_bas7_evaluation(spark, sf_dir):
    return baseline.evaluated(signed(spark, sf_dir)).select("event_id", "seen_before", "lineage_novel", "surprise_full", "promoted_upto", "known_stable")


_VIEW = r"lower(regexp_replace(command, '^\s+|\s+$', '', 'g'))"


_PLAIN = {name: p.replace(*routing.WITHOUT_LOOKAHEAD.get(name, ("", ""))) for name, p in routing.PATTERNS.items()}


def _re(pattern: str) -> str:
    flags = "s" if pattern.startswith("(?s)") else ""
    return f"regexp_matches({_VIEW}, '(?i{flags}{'m' if pattern.startswith('(?m)') else ''}){pattern.removeprefix('(?s)').removeprefix('(?m)')}')"


@query(WITH + " SELECT event_id, " + ", ".join(f"{_re(p)} AS {name}" for name, p in _PLAIN.items()) + " FROM commands")
def rte1_routing_features(spark, sf_dir):
    return routing.with_features(commands(spark, sf_dir)).select("event_id", "f.*")


_SUSPECT = " OR ".join(_re(_PLAIN[name]) for name in routing.SUSPICIOUS)


@query(
    WITH + f", f AS (SELECT event_id, (value % 100) / 100.0 AS benign, ({_SUSPECT}) AS forced FROM commands) "
    "SELECT event_id, CASE WHEN forced OR benign < 0.5 THEN 'Suspicious' ELSE 'Benign' END AS label, round(CASE WHEN forced THEN greatest(1 - benign, 0.9) ELSE greatest(1 - benign, benign) END, 6) AS confidence FROM f"
)
def rte2_rte5_route(spark, sf_dir):
    rows = routing.with_features(commands(spark, sf_dir)).withColumn("s", routing.suspicious_features(F.col("f")))
    r = rows.withColumn("r", routing.route((F.col("value") % 100) / 100.0, F.col("s")))
    return r.select("event_id", "r.label", F.round("r.confidence", 6).alias("confidence"))


@query(WITH + " SELECT event_id, command AS decoded, 'bare_base64' AS transforms, 'stable' AS stop_reason FROM commands")
def dec11_decode_trace(spark, sf_dir):
    packed = commands(spark, sf_dir).select("event_id", F.regexp_replace(F.base64(F.encode("command", "utf-8")), r"\s", "").alias("command"))
    d = decoding.decode(packed)
    return d.select("event_id", F.col("decode.final").alias("decoded"), F.array_join("decode.steps.transform", ",").alias("transforms"), "decode.stop_reason")


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


@query(
    WITH + f", t AS (SELECT event_id, unnest(string_split({TEXT}, ' ')) AS w FROM commands), m AS (SELECT event_id, CASE lower(string_split(w, '/')[-1]) "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in parsing.INTERPRETERS.items())
    + " END AS i FROM t WHERE NOT starts_with(w, '-')) SELECT event_id, coalesce(string_agg(DISTINCT i, ' ' ORDER BY i), '') AS interpreters FROM m GROUP BY 1"
)
def par13_interpreters(spark, sf_dir):
    return commands(spark, sf_dir).select("event_id", F.array_join(F.array_sort(parsing.interpreter_markers(F.col("command"))), " ").alias("interpreters"))


@query(WITH + " SELECT event_id, CASE WHEN event_id % 13 = 8 THEN 'https://files.example.org:8443/a' || CAST(substr(host_id, 2)::INT % 4 AS STRING) || '.sh' ELSE '' END AS urls FROM commands")
def ioc3_refanged_urls(spark, sf_dir):
    fanged = F.replace(F.replace(F.col("command"), F.lit("https"), F.lit("hxxps")), F.lit("example.org"), F.lit("example[.]org"))
    return commands(spark, sf_dir).select("event_id", F.array_join(parsing.refanged_urls(fanged), " ").alias("urls"))
