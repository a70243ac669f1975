"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdlake.llm.common import cut, dealt


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of links (a, b), by alternating large and small stars."""
    rows = links.count()
    edges = cut(dealt(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), rows))
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = dealt(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), rows)
        large = dealt(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v"), rows)
        # small star: the smaller neighbours of a node, and the node, meet its smallest
        low = dealt(large.groupBy("u").agg(F.min("v").alias("m")), rows)
        small = dealt(large.join(low, "u"), rows).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v").distinct()
        edges = cut(dealt(small, rows))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
        before = now
