"""Queries that link rows by shared keys and split them without dividing a group."""

from __future__ import annotations

from pyspark.sql import functions as F

from cmdlake.functions.text import dedup_key
from cmdlake.operators.digests import multiset_digest, multiset_digest_sql
from cmdlake.operators.graph import key_components, key_links
from cmdlake.operators.splits import LABEL_WEIGHT, SIDES, isolated_split
from cmdlake.plans.dataset_queries import KEY, LABEL_SQL, docs, labelled

QUERIES, ORACLE = {}, {}
KINDS = ["copy", "head", "tail"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def keyed(rows):
    """rows with a key of the whole text, of its first and of its last four words: near copies and reused openings link across kinds."""
    words = F.split(dedup_key(F.col("text")), " ")
    some = {"copy": words, "head": F.slice(words, 1, 4), "tail": F.slice(words, F.greatest(F.size(words) - 3, F.lit(1)), 4)}
    return rows.withColumns({k: F.sha2(F.array_join(w, " "), 256) for k, w in some.items()})


def linked_sql(rows: str) -> str:
    """CTEs k (doc_id, key) and c (doc_id, component) of a query with doc_id and text."""
    return (
        f"WITH RECURSIVE w AS (SELECT doc_id, string_split({KEY}, ' ') AS w FROM ({rows})), "
        "s AS (SELECT doc_id, array_to_string(w, ' ') AS copy, array_to_string(w[1:4], ' ') AS head, array_to_string(w[greatest(len(w) - 3, 1):], ' ') AS tail FROM w), "
        "k AS (" + " UNION ".join(f"SELECT doc_id, '{k}:' || sha256({k}) AS key FROM s" for k in KINDS) + "), "
        "h AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY key) AS b FROM k), e AS (SELECT a, b FROM h WHERE a <> b UNION SELECT b, a FROM h WHERE a <> b), "
        "r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS doc_id, min(b) AS component FROM r GROUP BY 1)"
    )


def dealt_sql(labels: list[str], relative: bool) -> str:
    """CTEs that deal the components of c (and labels of l: doc_id, label) one by one, ending in a (component, split)."""
    dims, sides = range(len(labels) + 1), range(len(SIDES))
    shares = list(SIDES.values())
    has = [f"h{s}_{d}" for s in sides for d in dims]
    target = lambda s, d: f"{shares[s]} * t{d}"
    unit = lambda s, d: f"{1.0 if d == 0 else LABEL_WEIGHT}" + (f" / greatest({target(s, d)}, 1.0)" if relative else "")
    cost = lambda s: "round(" + " + ".join(f"{unit(s, d)} * c{d} * (2 * (h{s}_{d} - {target(s, d)}) + c{d})" for d in dims) + ", 9)"
    counts = "".join(f", count(*) FILTER (label = '{x}') AS c{i + 1}" for i, x in enumerate(labels))
    by = "'[' || array_to_string(list_filter([" + ", ".join(f"CASE WHEN c{i + 1} > 0 THEN '{{\"l\":\"{x}\",\"c\":' || c{i + 1} || '}}' END" for i, x in enumerate(labels)) + "], lambda x: x IS NOT NULL), ',') || ']'" if labels else "'[]'"
    grown = ", ".join(f"h{s}_{d} + CASE WHEN side = {s} THEN c{d} ELSE 0 END" for s in sides for d in dims)
    return (
        f", g AS (SELECT component, count(*) AS c0{counts} FROM c" + (" JOIN l USING (doc_id)" if labels else "") + " GROUP BY 1), "
        + "t AS (SELECT " + ", ".join(f"CAST(sum(c{d}) AS DOUBLE) AS t{d}" for d in dims) + " FROM g), "
        + f"b AS (SELECT *, {by} AS by_label FROM g), o AS (SELECT b.*, t.*, row_number() OVER (ORDER BY c0 DESC, by_label) AS i, row_number() OVER (PARTITION BY c0, by_label ORDER BY sha256(CAST(component AS VARCHAR))) AS n FROM b, t), "
        + f"z(i, side, {', '.join(has)}) AS (SELECT CAST(0 AS BIGINT), -1, {', '.join('CAST(0 AS DOUBLE)' for _ in has)} UNION ALL SELECT i, side, {grown} FROM (SELECT *, CASE WHEN k0 <= k1 AND k0 <= k2 THEN 0 WHEN k1 <= k2 THEN 1 ELSE 2 END AS side FROM "
        + f"(SELECT o.*, {', '.join(has)}, {', '.join(f'{cost(s)} AS k{s}' for s in sides)} FROM z JOIN o ON o.i = z.i + 1))), "
        + "x AS (SELECT c0, by_label, count(*) FILTER (side = 0) AS x0, count(*) FILTER (side = 1) AS x1 FROM z JOIN o USING (i) GROUP BY 1, 2), "
        + "a AS (SELECT component, CASE WHEN n <= x0 THEN 'train' WHEN n <= x0 + x1 THEN 'validation' ELSE 'test' END AS split FROM o JOIN x USING (c0, by_label))"
    )


def linked(rows):
    return rows.join(key_components(rows, "doc_id", KINDS), "doc_id")


@query(linked_sql("SELECT doc_id, text FROM documents") + " SELECT doc_id, component FROM c")
def grp1_linked_documents(spark, sf_dir):
    return key_components(keyed(docs(spark, sf_dir).select("doc_id", "text")).drop("text"), "doc_id", KINDS)


@query(
    linked_sql("SELECT doc_id, text FROM documents") + dealt_sql([], False)
    + f", i AS (SELECT component, {multiset_digest_sql('key')} AS holdout FROM (SELECT DISTINCT component, key FROM k JOIN c USING (doc_id)) GROUP BY 1) SELECT doc_id, component, holdout, split FROM c JOIN a USING (component) JOIN i USING (component)"
)
def dst10_component_split(spark, sf_dir):
    """Components dealt whole, each named by a digest of all keys of its rows."""
    rows = keyed(docs(spark, sf_dir).select("doc_id", "text")).drop("text")
    found = key_components(rows, "doc_id", KINDS)
    named = key_links(rows, "doc_id", KINDS).join(found, "doc_id").select("component", "key").distinct().groupBy("component").agg(multiset_digest(F.col("key")).alias("holdout"))
    return isolated_split(found, "component").join(named, "component").select("doc_id", "component", "holdout", "split")


_LABELLED = f"SELECT doc_id, text, {LABEL_SQL} AS label FROM documents JOIN labels USING (doc_id)"
_BALANCED = linked_sql(_LABELLED) + f", l AS (SELECT doc_id, label FROM ({_LABELLED}))" + dealt_sql(["Benign", "Context", "Malicious"], True)


def balanced(spark, sf_dir):
    rows = keyed(labelled(spark, sf_dir).select("doc_id", "text", "label")).drop("text")
    return isolated_split(linked(rows), "component", F.array("label"))


@query(_BALANCED + " SELECT doc_id, component, label, split FROM c JOIN l USING (doc_id) JOIN a USING (component)")
def dst11_label_balanced_split(spark, sf_dir):
    return balanced(spark, sf_dir).select("doc_id", "component", "label", "split")


@query(_BALANCED + " SELECT label, split, count(*) AS n, count(DISTINCT component) AS n_groups, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM c JOIN l USING (doc_id) JOIN a USING (component) GROUP BY 1, 2")
def dst11_label_shares(spark, sf_dir):
    from pyspark.sql import Window

    n = balanced(spark, sf_dir).groupBy("label", "split").agg(F.count("*").alias("n"), F.countDistinct("component").alias("n_groups"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("label")), 6))  # a row a label and split
