"""Ranks and running sums over whole tables or hot groups without sorting either in one task.

Rows are cut into slots by their order: slots are counted first, a slot starts where the slots before it end, and only
the rows of one slot are sorted together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leading hex digits that make a slot: 4,096 slots a group; SPLITS ranges of values.
DIGITS, SPLITS = 3, 256


def ranked(df: DataFrame, digest: Column, name: str = "rank", groups: tuple[str, ...] = (), most: int | None = None, total: str | None = None, digits: int = DIGITS) -> DataFrame:
    """df with its 1-based rank by a hex digest within the groups, up to ``most`` a group; ``total`` names the group's size.  Null groups are one group."""
    rows = df.withColumns({"__order": digest, "__slot": F.substring(digest, 1, digits)})
    keys = [*groups, "__slot"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__in"))
    own = Window.partitionBy(*groups)
    starts = counts.select(*keys, (F.sum("__in").over(own.orderBy("__slot")) - F.col("__in")).alias("__start"), F.sum("__in").over(own).alias("__all"))
    local = rows.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy("__order")))
    if most is not None:
        local, starts = local.filter(F.col("__at") <= most), starts.filter(F.col("__start") < most)
    starts = starts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__start", "__all")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    out = local.join(starts, on).withColumn(name, F.col("__start") + F.col("__at"))
    if most is not None:
        out = out.filter(F.col(name) <= most)
    if total:
        out = out.withColumn(total, F.col("__all"))
    return out.drop("__order", "__slot", "__at", "__start", "__all", *[f"__k{i}" for i in range(len(keys))])


def running(df: DataFrame, value: str, sums: dict[str, str]) -> DataFrame:
    """df of distinct values with, for each name in sums, the sum of its column over all values as large or larger."""
    cuts = df.agg(F.percentile_approx(value, [i / SPLITS for i in range(1, SPLITS)]).alias("__cuts"))  # one row of fixed width
    rows = df.crossJoin(F.broadcast(cuts)).withColumn("__slot", F.size(F.filter("__cuts", lambda c: c <= F.col(value)))).drop("__cuts")
    down = Window.orderBy(F.desc("__slot"))  # over at most SPLITS rows
    parts = rows.groupBy("__slot").agg(*[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()])
    before = parts.select("__slot", *[(F.sum(f"__s_{n}").over(down) - F.col(f"__s_{n}")).alias(f"__b_{n}") for n in sums])
    own = Window.partitionBy("__slot").orderBy(F.desc(value))
    out = rows.join(before, "__slot").withColumns({n: F.sum(c).over(own) + F.col(f"__b_{n}") for n, c in sums.items()})
    return out.drop("__slot", *[f"__b_{n}" for n in sums])


def sums_before(df: DataFrame, digest: Column, value: str, name: str, total: str) -> DataFrame:
    """df with the sum of a column over all rows before it by a hex digest, and over all rows; equal digests have no order."""
    rows = df.withColumns({"__order": digest, "__slot": F.substring(digest, 1, DIGITS)})
    slots = rows.groupBy("__slot").agg(F.sum(value).alias("__in"))
    every = Window.partitionBy(F.lit(0))  # over at most 16**DIGITS slots
    starts = slots.select("__slot", (F.sum("__in").over(every.orderBy("__slot")) - F.col("__in")).alias("__start"), F.sum("__in").over(every).alias(total))
    own = Window.partitionBy("__slot").orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(starts, "__slot").withColumn(name, F.col("__start") + F.coalesce(F.sum(value).over(own), F.lit(0))).drop("__order", "__slot", "__start")
