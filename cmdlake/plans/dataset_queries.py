"""Queries that build labelled datasets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cmdlake.functions.text import dedup_key
from cmdlake.operators import datasets
from cmdlake.operators.graph import key_components
from cmdlake.operators.ranking import ranked
from cmdlake.sources.gallery import GALLERY_SQL, gallery

QUERIES, ORACLE = {}, {}
KEY = r"lower(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))"
LABEL_SQL = "CASE WHEN toxic = 1 THEN 'Malicious' WHEN quality = 0 THEN 'Context' ELSE 'Benign' END"
LABELLED = f"WITH d AS (SELECT d.doc_id, d.source, {KEY} AS key, {LABEL_SQL} AS label FROM documents d JOIN labels USING (doc_id))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def docs(spark, sf_dir, name="documents"):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key():
    return dedup_key(F.col("text"))


def labelled(spark, sf_dir):
    label = F.when(F.col("toxic") == 1, "Malicious").when(F.col("quality") == 0, "Context").otherwise("Benign")
    return docs(spark, sf_dir).select("doc_id", "text", "source").join(docs(spark, sf_dir, "labels"), "doc_id").withColumn("label", label)


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {KEY} ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def agg1_keep_first(spark, sf_dir):
    # rows are told apart by a digest of the key, so that whole texts aren't shuffled
    keyed = docs(spark, sf_dir).select("doc_id", F.sha2(key(), 256).alias("digest"))
    return keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query(
    LABELLED + ", r AS (SELECT sha256(key) AS key, label, CASE label WHEN 'Malicious' THEN 0 WHEN 'Context' THEN 1 ELSE 2 END AS rank FROM d) "
    "SELECT key, min_by(label, rank) AS label, count(*) AS n_rows, count(DISTINCT label) AS n_labels FROM r GROUP BY key"
)
def agg2_resolved_labels(spark, sf_dir):
    return datasets.resolved(labelled(spark, sf_dir), F.sha2(key(), 256), "label", {"Malicious": 0, "Context": 1, "Benign": 2})


@query(LABELLED + " SELECT sha256(key) AS key, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, count(*) AS n_rows FROM d GROUP BY key HAVING count(DISTINCT label) > 1")
def agg3_conflicts(spark, sf_dir):
    return datasets.conflicts(labelled(spark, sf_dir), F.sha2(key(), 256), "label").select("key", F.array_join("labels", ",").alias("labels"), "n_rows")


@query("SELECT source, lang, count(*) AS n, min(n_chars) AS shortest, max(n_chars) AS longest, round(avg(n_chars), 6) AS mean, quantile_cont(n_chars, 0.5) AS median FROM documents GROUP BY 1, 2")
def agg5_summary(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("source", "lang").agg(
        F.count("*").alias("n"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), F.round(F.avg("n_chars"), 6).alias("mean"), F.percentile("n_chars", F.lit(0.5)).alias("median")
    )


@query("SELECT coalesce(source, 'ALL') AS source, coalesce(lang, 'ALL') AS lang, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)")
def agg6_rollup(spark, sf_dir):
    return docs(spark, sf_dir).rollup("source", "lang").agg(F.count("*").alias("n")).select(F.coalesce("source", F.lit("ALL")).alias("source"), F.coalesce("lang", F.lit("ALL")).alias("lang"), "n")


@query("SELECT doc_id FROM documents WHERE lower(text) NOT IN (SELECT lower(text) FROM benchmark)")
def joi1_decontaminated(spark, sf_dir):
    # the key is the one of the other queries; the SQL's lower(text) tells apart what differs in white space only
    digest = F.sha2(key(), 256)
    return datasets.without(docs(spark, sf_dir), digest, docs(spark, sf_dir, "benchmark"), digest).select("doc_id")


@query(
    "SELECT c.conv_id, c.turn, EXISTS (SELECT 1 FROM conversations o WHERE o.conv_id <> c.conv_id AND o.text = c.text) AS shared FROM conversations c"
)
def joi3_exposure_flag(spark, sf_dir):
    rows = docs(spark, sf_dir, "conversations")
    many = rows.groupBy("text").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi")).filter("lo <> hi")
    return datasets.flagged(rows, F.col("text"), many, F.col("text"), "shared").select("conv_id", "turn", "shared")


@query(
    f"WITH k AS (SELECT DISTINCT sha256({KEY}) AS key, source AS s FROM documents) "
    "SELECT a.s AS left_split, b.s AS right_split, count(*) AS shared FROM k a JOIN k b ON a.key = b.key AND a.s < b.s GROUP BY 1, 2"
)
def joi4_split_overlaps(spark, sf_dir):
    return datasets.split_overlaps(docs(spark, sf_dir), F.sha2(key(), 256), "source")


@query(
    f"WITH k AS (SELECT role AS s, lower(command) AS key, list_sort(list(DISTINCT CASE WHEN value < 50 THEN 'Benign' ELSE 'Context' END)) AS labels FROM ({GALLERY_SQL}) GROUP BY 1, 2) "
    "SELECT a.s AS left_split, b.s AS right_split, count(*) AS shared, CAST(sum(CAST(CASE WHEN a.s = b.s THEN len(a.labels) > 1 ELSE a.labels <> b.labels END AS INTEGER)) AS BIGINT) AS conflicting FROM k a JOIN k b ON a.key = b.key AND a.s <= b.s GROUP BY 1, 2"
)
def joi4_split_audit(spark, sf_dir):
    """Commands that two roles share, and those whose labels differ between them."""
    rows = gallery(spark, sf_dir).withColumn("label", F.when(F.col("value") < 50, "Benign").otherwise("Context"))
    return datasets.split_audit(rows, F.lower("command"), "label", "role")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || CAST(doc_id AS STRING))) AS n FROM documents) WHERE n <= 20")
def win1_capped(spark, sf_dir):
    order = F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256)
    return datasets.capped(docs(spark, sf_dir).select("doc_id", "source"), "source", 20, order)


@query("SELECT doc_id, lang FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY lang HAVING count(*) >= 120)")
def win2_minimum(spark, sf_dir):
    return datasets.above_minimum(docs(spark, sf_dir).select("doc_id", "lang"), "lang", 120)


@query(
    "WITH r AS (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n, (row_number() OVER (PARTITION BY source ORDER BY sha256('11:' || CAST(doc_id AS STRING))) - 1) / count(*) OVER (PARTITION BY source) AS share FROM documents) "
    "SELECT doc_id, source, CASE WHEN n < 3 OR share < 0.8 THEN 'train' WHEN share < 0.9 THEN 'validation' ELSE 'test' END AS split FROM r"
)
def win3_stratified_split(spark, sf_dir):
    order = F.sha2(F.concat(F.lit("11:"), F.col("doc_id").cast("string")), 256)
    return datasets.stratified_split(docs(spark, sf_dir).select("doc_id", "source"), "source", order, 0.8, 0.9 - 0.8)


@query(
    f"WITH d AS (SELECT sha256({KEY}) AS key FROM documents), b AS (SELECT sha256({KEY}) AS key FROM benchmark) "
    "SELECT 'both' AS side, key FROM (SELECT key FROM d INTERSECT SELECT key FROM b) UNION ALL SELECT 'left', key FROM (SELECT key FROM d EXCEPT SELECT key FROM b)"
)
def set2_whole_tables(spark, sf_dir):
    digest = F.sha2(key(), 256).alias("key")
    return datasets.set_sides(docs(spark, sf_dir).select(digest), docs(spark, sf_dir, "benchmark").select(digest))


@query("SELECT p_partkey, n_nationkey, replace(replace('scan {part} --region {nation}', '{part}', p_name), '{nation}', n_name) AS command FROM part CROSS JOIN nation")
def dst6_all_nations(spark, sf_dir):
    nations = docs(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    made = F.replace(F.replace(F.lit("scan {part} --region {nation}"), F.lit("{part}"), F.col("p_name")), F.lit("{nation}"), F.col("n_name"))
    return docs(spark, sf_dir, "part").crossJoin(F.broadcast(nations)).select("p_partkey", "n_nationkey", made.alias("command"))


@query(LABELLED + ", c AS (SELECT label, count(*) AS n FROM d GROUP BY 1) SELECT label, n, round(sum(n) OVER () * 1.0 / (count(*) OVER () * n), 6) AS weight FROM c")
def dst15_class_weights(spark, sf_dir):
    counts = labelled(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n", F.round(F.col("total") / (F.col("k") * F.col("n")), 6).alias("weight"))


@query(
    f"SELECT source, count(*) AS loaded, count(DISTINCT sha256({KEY})) AS distinct_keys, count(*) - count(DISTINCT sha256({KEY})) AS duplicate_internal FROM documents GROUP BY 1"
)
def agg12_ingest_statistics(spark, sf_dir):
    keys = docs(spark, sf_dir).groupBy("source", F.sha2(key(), 256).alias("k")).agg(F.count("*").alias("n"))
    return keys.groupBy("source").agg(F.sum("n").alias("loaded"), F.count("*").alias("distinct_keys"), (F.sum("n") - F.count("*")).alias("duplicate_internal"))


@query(
    "SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders"
)
def grp1_components(spark, sf_dir):
    rows = docs(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"), (F.col("o_custkey") * 7 + 1).cast("string").alias("twin"))
    return key_components(rows, "o_orderkey", ["customer", "twin"])


@query(
    "SELECT doc_id, lang, CASE WHEN n <= 3 THEN 'train' WHEN n = 4 THEN 'validation' ELSE 'test' END AS split FROM "
    "(SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('5:' || CAST(doc_id AS STRING))) AS n FROM documents)"
)
def dst16_fixed_split(spark, sf_dir):
    rows = ranked(docs(spark, sf_dir).select("doc_id", "lang"), F.sha2(F.concat(F.lit("5:"), F.col("doc_id").cast("string")), 256), "n", ("lang",))
    return rows.select("doc_id", "lang", F.when(F.col("n") <= 3, "train").when(F.col("n") == 4, "validation").otherwise("test").alias("split"))


@query("SELECT lang, source, n FROM (SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS r FROM documents GROUP BY 1, 2) WHERE r <= 3")
def top1_ranks(spark, sf_dir):
    counts = docs(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "source"))).filter("r <= 3").drop("r")


@query(
    "SELECT doc_id, sha256(text) AS id, CAST(NULL AS STRING) AS verdict, CAST(NULL AS STRING) AS rationale FROM (SELECT doc_id, text FROM documents ORDER BY sha256('13:' || CAST(doc_id AS STRING)) LIMIT 50)"
)
def rev1_blind_queue(spark, sf_dir):
    queue = docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("id")).orderBy(F.sha2(F.concat(F.lit("13:"), F.col("doc_id").cast("string")), 256)).limit(50)
    return queue.select("doc_id", "id", F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("rationale"))


@query(f"WITH w AS (SELECT {LABEL_SQL} AS label, CASE WHEN quality = 1 THEN 'Benign' ELSE 'Context' END AS old FROM labels) SELECT old AS old_label, label AS new_label, count(*) AS n FROM w GROUP BY 1, 2")
def dst2_transitions(spark, sf_dir):
    label = F.when(F.col("toxic") == 1, "Malicious").when(F.col("quality") == 0, "Context").otherwise("Benign")
    old = F.when(F.col("quality") == 1, "Benign").otherwise("Context")
    return docs(spark, sf_dir, "labels").groupBy(old.alias("old_label"), label.alias("new_label")).agg(F.count("*").alias("n"))
