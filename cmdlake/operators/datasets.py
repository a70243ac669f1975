"""Table operators for labelled datasets: deduplication, quarantine, joins, splits and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cmdlake.operators.ranking import ranked


def keep_first(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key by a total order."""
    nth = F.row_number().over(Window.partitionBy("__key").orderBy(*order))
    return df.withColumn("__key", key).withColumn("__n", nth).filter("__n = 1").drop("__key", "__n")


def conflicts(df: DataFrame, key: Column, label: str) -> DataFrame:
    """key, labels (sorted) and rows of keys with more than one label."""
    return (
        df.groupBy(key.alias("key")).agg(F.array_sort(F.collect_set(label)).alias("labels"), F.count("*").alias("n_rows")).filter(F.size("labels") > 1)
    )


def resolved(df: DataFrame, key: Column, label: str, priority: dict) -> DataFrame:
    """One label per key: that of the best priority (smallest number); and how many rows it came from."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv]), F.col(label)), F.lit(len(priority)))
    return df.groupBy(key.alias("key")).agg(F.min_by(label, F.struct(rank, F.col(label))).alias("label"), F.count("*").alias("n_rows"), F.countDistinct(label).alias("n_labels"))


def without(df: DataFrame, key: Column, other: DataFrame, other_key: Column) -> DataFrame:
    """Rows whose key doesn't occur in other."""
    return df.withColumn("__key", key).join(other.select(other_key.alias("__key")), "__key", "left_anti").drop("__key")


def set_sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """side, then left's columns: distinct rows of left that right holds too ('both') and those that it doesn't ('left')."""
    both, only = left.intersect(right), left.subtract(right)
    return both.select(F.lit("both").alias("side"), "*").unionByName(only.select(F.lit("left").alias("side"), "*"))


def flagged(df: DataFrame, key: Column, other: DataFrame, other_key: Column, name: str) -> DataFrame:
    """Adds whether a row's key occurs in other."""
    seen = other.select(other_key.alias("__key")).distinct().withColumn(name, F.lit(True))
    return df.withColumn("__key", key).join(seen, "__key", "left").drop("__key").withColumn(name, F.coalesce(name, F.lit(False)))


def capped(df: DataFrame, group: str, cap: int, order: Column) -> DataFrame:
    """At most cap rows a group, the first by a hex digest: the operator's own limit."""
    return ranked(df, order, "__n", (group,), most=cap).drop("__n")


def above_minimum(df: DataFrame, group: str, least: int) -> DataFrame:
    """Rows of groups with enough rows; counts are pre-aggregated, so a large group isn't gathered."""
    big = df.groupBy(group).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least).select(group)
    return df.join(big, group, "left_semi")


def stratified_split(df: DataFrame, group: str, order: Column, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """Adds split by the rank of a hex digest within the group; groups under three rows train whole."""
    rows, n = ranked(df, order, "__n", (group,), total="__size"), F.col("__size")
    share = (F.col("__n") - 1) / n
    return rows.withColumn("split", F.when((n < 3) | (share < train), "train").when(share < train + validation, "validation").otherwise("test")).drop("__n", "__size")


def split_audit(df: DataFrame, key: Column, label: str, split: str) -> DataFrame:
    """left_split, right_split, shared, conflicting: keys in common, and those of them whose sets of labels differ.

    A split beside itself gives its keys, and those with more than one label.  A key's labels and splits are few.
    """
    keys = df.groupBy(key.alias("key"), F.col(split).alias("s")).agg(F.array_sort(F.collect_set(label)).alias("labels"))
    same, several = F.col("a.s") == F.col("b.s"), F.size("a.labels") > 1
    clash = F.when(same, several).otherwise(F.col("a.labels") != F.col("b.labels"))
    return (
        keys.alias("a").join(keys.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.s") <= F.col("b.s")))
        .groupBy(F.col("a.s").alias("left_split"), F.col("b.s").alias("right_split"))
        .agg(F.count("*").alias("shared"), F.sum(clash.cast("long")).alias("conflicting"))
    )


def split_overlaps(df: DataFrame, key: Column, split: str) -> DataFrame:
    """left, right, shared: keys that two splits have in common."""
    keys = df.select(key.alias("key"), F.col(split).alias("s")).distinct()
    return (
        keys.alias("a").join(keys.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.s") < F.col("b.s")))
        .groupBy(F.col("a.s").alias("left_split"), F.col("b.s").alias("right_split")).agg(F.count("*").alias("shared"))
    )
