"""Queries of what models learn from: term weights and folds that isolate groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from cmdlake.operators import learning
from cmdlake.plans.dataset_queries import docs
from cmdlake.sources.gallery import GALLERY_SQL, gallery

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_WORDS = r"regexp_extract_all(lower(trim(command)), '[a-z0-9_./:\\$%@=+-]+')"


@query(
    f"WITH g AS (SELECT event_id, {_WORDS} AS w FROM ({GALLERY_SQL})), t AS (SELECT event_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM g), c AS (SELECT event_id, term, count(*) AS c FROM t GROUP BY 1, 2), "
    "d AS (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 2), x AS (SELECT event_id, term, (1 + ln(c)) * (ln((1 + (SELECT count(*) FROM g)) / (1 + df)) + 1) AS w FROM c JOIN d USING (term)), n AS (SELECT event_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY 1) "
    "SELECT event_id, term, round(w / norm, 6) AS weight FROM x JOIN n USING (event_id)"
)
def ml1_term_weights(spark, sf_dir):
    """Words and pairs of words of every command, counted sublinearly."""
    rows = learning.with_grams(gallery(spark, sf_dir).select("event_id", "command"), F.col("command"))
    return learning.term_weights(rows, "event_id", "word_grams").withColumn("weight", F.round("weight", 6))


_FOLD = "CAST('0x' || substr(sha256(coalesce(source, '')), 1, 8) AS BIGINT) % n"


@query(
    f"WITH l AS (SELECT doc_id, source, toxic FROM documents JOIN labels USING (doc_id)), k AS (SELECT unnest([5, 4, 3, 2]) AS n), f AS (SELECT n, {_FOLD} AS fold, count(DISTINCT toxic) AS c FROM l CROSS JOIN k GROUP BY 1, 2), "
    f"b AS (SELECT max(n) AS n FROM (SELECT n FROM f GROUP BY n HAVING count(*) = n AND min(c) > 1)) SELECT doc_id, source, CAST({_FOLD} AS INTEGER) AS fold, CAST(n AS INTEGER) AS folds FROM l, b"
)
def ml3_group_folds(spark, sf_dir):
    """As many folds, up to five, as leave both classes in each."""
    labels = docs(spark, sf_dir, "labels").select("doc_id", "toxic")
    rows, n = learning.folds(docs(spark, sf_dir).select("doc_id", "source").join(labels, "doc_id"), "source", "toxic")
    return rows.select("doc_id", "source", "fold", F.lit(n).alias("folds"))
