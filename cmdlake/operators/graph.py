"""Groups of rows that share any provenance key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the cluster's shared checkpoint folder; a local session that names none uses one beside its warehouse."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and sc.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return df.checkpoint()


def key_links(rows: DataFrame, row: str, keys: list[str]) -> DataFrame:
    """row, key: a row for each distinct non-empty key of a row, under the name of its kind."""
    named = F.array(*[F.when(F.col(k).cast("string") != "", F.concat(F.lit(f"{k}:"), F.col(k).cast("string"))) for k in keys])
    return rows.select(row, F.explode(named).alias("key")).filter("key is not null").distinct()


def star_components(edges: DataFrame) -> DataFrame:
    """node, component: every node of the edges (a, b) and the smallest node that it can reach.

    Large and small stars in turn: the neighbours of a node move to the smallest node among them, so that long chains
    fold in a few rounds, each of which is cut off by a checkpoint.
    """
    down = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        around = down.union(down.select("b", "a"))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        # the smaller neighbours of a node follow it to its smallest
        small = large.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest)
        down = checkpointed(small.distinct())
        now = down.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return down.select(F.col("a").alias("node"), F.col("b").alias("component")).union(down.select("b", "b").distinct())
        seen = now


def key_components(rows: DataFrame, row: str, keys: list[str]) -> DataFrame:
    """row, component: the smallest row id linked through shared non-empty keys.

    A key links its rows to the smallest of them, never in pairs.
    """
    links = checkpointed(key_links(rows, row, keys))
    hubs = links.groupBy("key").agg(F.min(row).alias("b"), F.max(row).alias("last")).filter("b <> last").drop("last")
    found = star_components(links.join(hubs, "key").select(F.col(row).alias("a"), "b")).withColumnRenamed("node", row)
    return rows.select(row).distinct().join(found, row, "left").select(row, F.coalesce("component", row).alias("component"))
