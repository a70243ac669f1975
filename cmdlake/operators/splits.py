"""Train, validation and test without dividing a group, in even shares of rows and of every label."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdlake.operators.ranking import ranked

SIDES = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: How much a label's shares count beside the share of rows.
LABEL_WEIGHT = 2.0


def filled(first: np.ndarray, step: np.ndarray, m: int) -> np.ndarray:
    """How many of m equal groups each side gets if each goes to the side where it costs least: the x-th costs first + step * x there.

    Costs rise, so the level that all sides reach together tells all but a few groups; those go one by one.
    """
    x = np.zeros(len(first), np.int64)
    if m > 2 * len(first):
        open_ = np.ones(len(first), bool)
        while True:
            level = (m + (first / step)[open_].sum()) / (1 / step)[open_].sum()
            over = open_ & (first > level)
            if not over.any():
                break
            open_ &= ~over
        x[open_] = np.maximum(0, np.floor((level - first[open_]) / step[open_]) - 2)
    for _ in range(m - x.sum()):
        x[np.round(first + step * x, 9).argmin()] += 1
    return x


def dealt_counts(sizes: np.ndarray, times: np.ndarray, weights: np.ndarray, relative: bool) -> np.ndarray:
    """Of each kind of group (sizes: rows and rows of each label; times: groups of the kind), in order, the groups each side gets.

    The cost is the squared distance from every side's shares; relative: by the shares themselves.
    """
    shares = np.array(list(SIDES.values()))
    target = shares[:, None] * (sizes * times[:, None]).sum(0)[None]
    unit = weights / (np.maximum(target, 1.0) if relative else np.ones_like(target))
    has, out = np.zeros_like(target), []
    for c, m in zip(sizes, times, strict=True):
        first, step = (unit * c * (2 * (has - target) + c)).sum(1), (unit * 2 * c * c).sum(1)
        x = filled(first, step, int(m))
        has += x[:, None] * c
        out.append(x)
    return np.array(out, np.int64).reshape(-1, len(shares))


def isolated_split(df: DataFrame, group: str, labels: Column | None = None, relative: bool | None = None, strata: int = 1) -> DataFrame:
    """df with split: 80/10/10 of the rows, and of each label's rows if an array of labels is given, no group divided.

    Groups are dealt from the largest; each goes to the side whose squared deficits of rows (and, by twice the weight and
    relative to the sides' shares, of labels) it lowers most.  Groups of equal size and equal label counts are one
    row with a count and dealt at once, so that a task holds a row for each kind of group, never for each group; where
    even kinds are too many, ``strata`` deals as many hashed parts of them apart, each in shares of its own.
    A group has one row of counts, as long as there are labels.  Within a kind, groups are told apart by a digest.
    """
    each = df.select(F.col(group).alias("g"), (F.lit(None).cast("array<string>") if labels is None else labels.cast("array<string>")).alias("ls"))
    sizes = each.groupBy("g").agg(F.count("*").alias("n"))
    if labels is not None:
        by = each.select("g", F.explode(F.array_distinct("ls")).alias("l")).groupBy("g", "l").agg(F.count("*").alias("c"))
        by = by.groupBy(F.col("g").alias("h")).agg(F.array_sort(F.collect_list(F.struct("l", "c"))).alias("by"))
        sizes = sizes.join(by, F.col("g").eqNullSafe(F.col("h")), "left").drop("h")
    else:
        sizes = sizes.withColumn("by", F.lit(None).cast("array<struct<l:string,c:bigint>>"))
    sizes = sizes.select("g", "n", F.coalesce(F.to_json("by"), F.lit("[]")).alias("by"))
    kinds = sizes.groupBy("n", "by").agg(F.count("*").alias("m")).withColumn("stratum", F.pmod(F.xxhash64("n", "by"), F.lit(strata)))
    compare = labels is not None if relative is None else relative

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        import json

        frame = frame.sort_values(["n", "by"], ascending=[False, True]).reset_index(drop=True)
        counts = [{x["l"]: x["c"] for x in json.loads(b)} for b in frame["by"]]
        names = sorted(set().union(*counts)) if len(counts) else []
        vectors = np.array([[n, *[c.get(name, 0) for name in names]] for n, c in zip(frame["n"], counts, strict=True)], float)
        x = dealt_counts(vectors, frame["m"].to_numpy(), np.array([1.0] + [LABEL_WEIGHT] * len(names)), compare)
        return pd.DataFrame({"n": frame["n"], "by": frame["by"], "upto": x.cumsum(1).tolist()})

    upto = kinds.groupBy("stratum").applyInPandas(deal, "n long, by string, upto array<long>")
    own = ranked(sizes, F.sha2(F.coalesce(F.col("g").cast("string"), F.lit("")), 256), "rank", ("n", "by")).join(upto, ["n", "by"])
    side = F.element_at(F.array(*map(F.lit, SIDES)), F.size(F.filter("upto", lambda u: u < F.col("rank"))) + 1)
    return df.join(own.select(F.col("g").alias("__g"), side.alias("split")), F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
