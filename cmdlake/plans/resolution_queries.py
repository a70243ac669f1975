"""Queries of label resolution, repairs, broken rules, prevalence and shared lines, over data in which every case occurs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cmdlake.functions import evidence
from cmdlake.functions.text import dedup_key
from cmdlake.operators import datasets, resolution
from cmdlake.plans.behaviour_queries import _STRENGTH, _TEXTS, _URLS
from cmdlake.plans.dataset_queries import docs
from cmdlake.plans.triage_queries import RULED, ruled
from cmdlake.sources.gallery import ADMIN_SQL, GALLERY_SQL, gallery

QUERIES, ORACLE = {}, {}
LABELS = (resolution.BENIGN, resolution.CONTEXT, resolution.MALICIOUS)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# both galleries; commands of an odd length have one label, the others differ by event
_LABEL = "[" + ", ".join(f"'{x}'" for x in LABELS) + "][1 + (length(command) + CASE WHEN length(command) % 2 = 0 THEN (event_id // 7) % 3 ELSE 0 END) % 3]"
SOURCED = f"WITH g AS (SELECT event_id, 'g' AS side, command FROM ({GALLERY_SQL}) UNION ALL SELECT event_id, 'a', command FROM ({ADMIN_SQL})), s AS (SELECT *, {_LABEL} AS label, trim(regexp_replace(command, '\\s+', ' ', 'g')) AS key FROM g)"


def sourced(spark, sf_dir):
    side = lambda name, *sql: gallery(spark, sf_dir, *sql).select("event_id", F.lit(name).alias("side"), "command")
    n = F.length("command")
    return side("g").union(side("a", ADMIN_SQL)).withColumn("label", F.element_at(F.array(*map(F.lit, LABELS)), ((n + F.when(n % 2 == 0, F.floor(F.col("event_id") / 7) % 3).otherwise(0)) % 3 + 1).cast("int")))


_CURATED = "CASE key " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in resolution.CURATED.items()) + " END"


@query(
    SOURCED + f", c AS (SELECT key AS command, list_sort(list(DISTINCT label)) AS labels, count(*) AS n_rows, {_CURATED} AS given, regexp_matches(key, '(?i){'|'.join(resolution.INDICATORS)}') AS bad FROM s GROUP BY key) "
    "SELECT command, CASE WHEN given IS NOT NULL THEN given WHEN len(labels) = 1 THEN labels[1] WHEN bad THEN 'Malicious' WHEN list_contains(labels, 'Context_Dependent') THEN 'Context_Dependent' ELSE 'Benign' END AS label, "
    "CASE WHEN given IS NOT NULL THEN 'curated' WHEN len(labels) = 1 THEN 'agreed' WHEN bad THEN 'indicator' WHEN list_contains(labels, 'Context_Dependent') THEN 'context' ELSE 'benign' END AS basis, array_to_string(labels, ' ') AS labels, n_rows FROM c"
)
def agg2_label_chain(spark, sf_dir):
    return resolution.resolved_conflicts(sourced(spark, sf_dir)).withColumn("labels", F.array_join("labels", " "))


def _case(column: int) -> str:
    out = "CASE "
    for r in resolution.REPAIRS:
        out += f"WHEN label = '{r[1]}' AND regexp_matches(command, '(?i){r[2]}') THEN '{r[column]}' "
    return out + "END"


@query(SOURCED + f", r AS (SELECT label AS original_label, coalesce({_case(3)}, label) AS label, {_case(0)} AS repair FROM s) SELECT original_label, label, repair, count(*) AS n FROM r GROUP BY 1, 2, 3")
def dst2_repairs(spark, sf_dir):
    return resolution.transitions(resolution.repaired(sourced(spark, sf_dir)))


@query(SOURCED + " SELECT sha256(lower(key)) AS key, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, count(*) AS n_rows FROM s GROUP BY 1 HAVING count(DISTINCT label) > 1")
def agg3_command_conflicts(spark, sf_dir):
    found = datasets.conflicts(sourced(spark, sf_dir), F.sha2(dedup_key(F.col("command")), 256), "label")
    return found.select("key", F.array_join("labels", ",").alias("labels"), "n_rows")


_CHANGED = RULED + _STRENGTH + ", mm AS (SELECT event_id, event_id % 3 AS truth, CASE WHEN event_id % 4 < 3 THEN event_id % 3 ELSE (event_id + 1) % 3 END AS was, CASE WHEN event_id % 5 < 3 THEN event_id % 3 ELSE (event_id + 1 + event_id % 2) % 3 END AS now FROM g), fr AS (SELECT mm.*, list_sort(list_distinct(list_filter(string_split(fired_rules, ' '), lambda r: r <> ''))) AS rule_set FROM mm JOIN rs USING (event_id))"
_BREAKS = ", bg AS (SELECT rule_set, count(*) AS n, count(DISTINCT truth) AS n_truths FROM fr WHERE was = truth AND now <> truth GROUP BY 1)"


def changed(spark, sf_dir):
    e = F.col("event_id")
    return ruled(spark, sf_dir).select("event_id", "fired_rules", (e % 3).alias("truth"), F.when(e % 4 < 3, e % 3).otherwise((e + 1) % 3).alias("was"), F.when(e % 5 < 3, e % 3).otherwise((e + 1 + e % 2) % 3).alias("now"))


@query(_CHANGED + _BREAKS + " SELECT array_to_string(rule_set, ' ') AS rule_set, n, n_truths FROM bg")
def agg10_break_groups(spark, sf_dir):
    return resolution.break_groups(changed(spark, sf_dir), "was", "now", "truth").withColumn("rule_set", F.array_join("rule_set", " "))


@query(
    _CHANGED + _BREAKS
    + ", uu AS (SELECT rule_set, n, unnest(rule_set) AS r FROM bg), pp AS (SELECT r AS rules, n FROM uu UNION ALL SELECT a.r || ' ' || b.r, a.n FROM uu a JOIN uu b ON a.rule_set = b.rule_set AND a.r < b.r) SELECT rules, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_sets FROM pp GROUP BY 1"
)
def agg10_rule_subsets(spark, sf_dir):
    found = resolution.rolled_up(resolution.break_groups(changed(spark, sf_dir), "was", "now", "truth"))
    return found.withColumn("rules", F.array_join("rules", " "))


@query(
    _CHANGED + ", ee AS (SELECT unnest(rule_set) AS rule, truth, CAST(was <> truth AND now = truth AS INT) AS fixed, CAST(was = truth AND now <> truth AS INT) AS broke FROM fr), tt AS (SELECT rule, truth, count(*) AS fires, sum(fixed) AS fixes, sum(broke) AS breaks FROM ee GROUP BY 1, 2) "
    "SELECT rule, CAST(sum(fires) AS BIGINT) AS fires, CAST(sum(fixes) AS BIGINT) AS fixes, CAST(sum(breaks) AS BIGINT) AS breaks, arg_max(truth, breaks * 10 - truth) AS most_broken FROM tt GROUP BY 1 ORDER BY sum(breaks) DESC, sum(fixes), rule LIMIT 5"
)
def agg10_top_offenders(spark, sf_dir):
    return resolution.top_offenders(changed(spark, sf_dir), "was", "now", "truth", 5)


_FOUND = (
    f"WITH {_TEXTS}, u AS (SELECT id, text, unnest({_URLS}) AS url FROM t), h AS (SELECT DISTINCT id, text, lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/@?#]*@)?([^/:?#]+)', 1)) AS host FROM u), "
    r"x AS (SELECT id, 'url' AS type, url AS value FROM u UNION SELECT id, CASE WHEN regexp_matches(host, '^(\d{1,3}\.){3}\d{1,3}$') THEN 'ip' ELSE 'domain' END, host FROM h WHERE host <> '' "
    r"UNION SELECT id, 'hash', lower(unnest(regexp_extract_all(text, '\b(?:[A-Fa-f0-9]{64}|[A-Fa-f0-9]{40}|[A-Fa-f0-9]{32})\b'))) FROM t "
    r"UNION SELECT id, 'defanged_url', replace(replace(regexp_replace(regexp_replace(d, '[;,.!)]+$', ''), '\[\.\]', '.', 'g'), 'hxxps', 'https'), 'hxxp', 'http') FROM (SELECT id, unnest(regexp_extract_all(text, '(?i)\bhxxps?://[^\s\x22\x27<>|]+')) AS d FROM t)), "
    "pv AS (SELECT type, value, count(*) AS n, count(DISTINCT id % 17) AS n_hosts FROM x GROUP BY 1, 2)"
)


def seen(spark, sf_dir):
    text = F.concat_ws(" ", "url", "html", F.replace("url", F.lit("http"), F.lit("hxxp")), F.md5("url"))
    pages = docs(spark, sf_dir, "pages")
    found = evidence.indicator_records(pages.select("page_id", text.alias("text")), "page_id")
    return resolution.prevalence(found.withColumn("host", (F.col("page_id") % 17).cast("string")), "host")  # seventeen hosts report


@query(_FOUND + " SELECT type, value, n, n_hosts FROM pv")
def ioc10_all_types(spark, sf_dir):
    return seen(spark, sf_dir).drop("hosts")


@query(_FOUND + " SELECT type, rank, value, n FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, value) AS rank FROM pv) WHERE rank <= 5")
def ioc10_heavy_hitters(spark, sf_dir):
    """The most frequent values of each type; every task limits its own before they meet."""
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("n"), "value"))
    return seen(spark, sf_dir).withColumn("rank", rank).filter("rank <= 5").select("type", "rank", "value", "n")


@query(
    "WITH l AS (SELECT doc_id, sha256(line) AS d FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> ''), m AS (SELECT d FROM l GROUP BY d HAVING min(doc_id) <> max(doc_id)) "
    "SELECT doc_id, count(*) AS n_lines, count(m.d) AS n_shared FROM l LEFT JOIN m USING (d) GROUP BY 1"
)
def joi3_shared_lines(spark, sf_dir):
    lines = docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''").select("doc_id", F.sha2("line", 256).alias("d"))
    many = lines.groupBy("d").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo <> hi")
    return datasets.flagged(lines, F.col("d"), many, F.col("d"), "shared").groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.col("shared").cast("long")).alias("n_shared"))


@query(
    "WITH d AS (SELECT sha256(array_to_string(string_split(text, ' ')[1:2], ' ')) AS key, lang, toxic FROM documents LEFT JOIN labels USING (doc_id)) "
    "SELECT key, array_to_string(list_sort(list(DISTINCT lang)), ' ') AS langs, count(*) AS rows_merged, coalesce(count(DISTINCT toxic) > 1, false) AS conflict FROM d GROUP BY 1"
)
def agg4_merged_openings(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "lang", F.sha2(F.array_join(F.slice(F.split("text", " "), 1, 2), " "), 256).alias("key")).join(docs(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("lang")), " ").alias("langs"), F.count("*").alias("rows_merged"), F.coalesce(F.min("toxic") != F.max("toxic"), F.lit(False)).alias("conflict"))
