"""Group bootstraps: whole groups are drawn anew, with the uncertainty of statistics that sums by group determine.

Rows shrink to one vector of sums per group.  A draw gives each group a Poisson(1) weight; a task adds its groups' vectors
under all draws' weights by one matrix product, so that as many rows as draws leave a task, and no group meets a draw as a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A draw's uniform is (a * draw + b) mod PRIME, a and b from the group's SHA-256: independent over groups, pairwise independent over draws.
PRIME = (1 << 31) - 1
#: A weight is the number of these that the uniform reaches: the distribution of Poisson(1), up to six.
STEPS = [int(p * PRIME) for p in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)]


def seeds(group: Column, seed: int) -> tuple[Column, Column]:
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), group.cast("string")), 256)
    part = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    return part(1) % (PRIME - 1) + 1, part(9) % PRIME


def weights_sql(group: str, seed: int, draw: str) -> str:
    """The weight of a group in a draw as DuckDB SQL."""
    part = lambda at: f"CAST('0x' || substr(sha256('{seed}:' || CAST({group} AS VARCHAR)), {at}, 8) AS BIGINT)"
    u = f"(({part(1)} % {PRIME - 1} + 1) * {draw} + {part(9)} % {PRIME}) % {PRIME}"
    return f"len(list_filter([{', '.join(map(str, STEPS))}], lambda s: s <= {u}))"


def drawn_sums(groups: DataFrame, group: str, stats: list[Column], draws: int, seed: int = 42) -> DataFrame:
    """draw (1 to draws) and s, an array: each statistic summed over the groups, one row a group, under the draw's weights."""
    a, b = seeds(F.col(group), seed)
    rows = groups.select(a.alias("a"), b.alias("b"), F.array(*[c.cast("double") for c in stats]).alias("s"))
    k, at = len(stats), np.arange(1, draws + 1)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros((draws, k)), False
        for pdf in frames:
            for i in range(0, len(pdf), 512):
                part, seen = pdf.iloc[i : i + 512], True
                u = (part["a"].to_numpy()[:, None] * at + part["b"].to_numpy()[:, None]) % PRIME
                total += np.searchsorted(STEPS, u, side="right").T.astype(float) @ np.stack(part["s"])
        if seen:
            yield pd.DataFrame({"draw": at, "s": list(total)})

    each = rows.mapInPandas(sums, "draw int, s array<double>")
    return each.groupBy("draw").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(k)]).alias("s"))


def interval(draws: DataFrame, **values: Column) -> DataFrame:
    """name_low and name_high of each value: the 2.5 and 97.5 percent quantiles over the draws."""
    return draws.select(*[v.alias(n) for n, v in values.items()]).agg(*[F.percentile(n, F.lit(q)).alias(f"{n}_{end}") for n in values for end, q in (("low", 0.025), ("high", 0.975))])


def paired_rows(left: DataFrame, right: DataFrame, key: str, group: str) -> DataFrame:
    """key, group, target, a and b (the classes as either model ranks them, best first) of two tables over the same rows.

    Both hold key, target and ranked (an array), left the group.  A key that occurs twice or on one side alone, or whose
    targets differ, is an error when its row is read.
    """
    a = left.select(F.col(key).alias("k"), F.col(group).alias("g"), F.col("target").alias("t"), F.col("ranked").alias("x"), F.lit(0).alias("side"))
    b = right.select(F.col(key).alias("k"), F.lit(None).cast(a.schema["g"].dataType).alias("g"), F.col("target").alias("t"), F.col("ranked").alias("x"), F.lit(1).alias("side"))
    pick = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    n = lambda side: F.sum((F.col("side") == side).cast("int"))
    both = a.union(b).groupBy("k").agg(n(0).alias("n0"), n(1).alias("n1"), pick("g", 0).alias("g"), pick("t", 0).alias("t"), pick("t", 1).alias("u"), pick("x", 0).alias("a"), pick("x", 1).alias("b"))
    fault = F.when((F.col("n0") > 1) | (F.col("n1") > 1), "a key occurs twice").when((F.col("n0") != 1) | (F.col("n1") != 1) | ~F.col("t").eqNullSafe(F.col("u")), "keys or targets of the two tables differ")
    target = F.when(fault.isNull(), F.col("t")).otherwise(F.raise_error(fault).cast(a.schema["t"].dataType))
    return both.select(F.col("k").alias(key), F.col("g").alias(group), target.alias("target"), "a", "b")


def _hits(side: str, top: int) -> Column:
    return F.array_contains(F.slice(F.col(side), 1, top), F.col("target")).cast("long")


def _cells(side: str, c) -> list[Column]:
    """True positives, and twice the true positives with all misses and false alarms, of a class."""
    said, is_ = F.col(side)[0] == c, F.col("target") == c
    return [(said & is_).cast("long"), said.cast("long") + is_.cast("long")]


def _macro(s: Column, first: int, n: int) -> Column:
    f1 = [F.when(s[first + 2 * i + 1] > 0, 2 * s[first + 2 * i] / s[first + 2 * i + 1]).otherwise(0.0) for i in range(n)]
    return sum(f1[1:], f1[0]) / n


def paired_comparison(rows: DataFrame, group: str, classes: list, tops: tuple[int, ...] = (1, 2), draws: int = 2000, seed: int = 42) -> DataFrame:
    """One row for rows of paired_rows: n, groups, and b's less a's macro-F1 (if classes are given) and share of targets among its first 1, 2, ..., each with its interval."""
    stats = [F.lit(1), *[_hits("b", k) - _hits("a", k) for k in tops], *[c for side in "ab" for x in classes for c in _cells(side, x)]]
    names = [f"s{i}" for i in range(len(stats))]
    groups = rows.groupBy(group).agg(*[F.sum(c).alias(n) for c, n in zip(stats, names, strict=True)])
    s, at = F.col("s"), 1 + len(tops)
    deltas = {f"top{k}": s[i + 1] / s[0] for i, k in enumerate(tops)}
    if classes:
        deltas["macro_f1"] = _macro(s, at + 2 * len(classes), len(classes)) - _macro(s, at, len(classes))
    whole = groups.agg(F.array(*[F.sum(n).cast("double") for n in names]).alias("s"), F.count("*").alias("groups"))
    whole = whole.select(s[0].cast("long").alias("n"), "groups", *[v.alias(n) for n, v in deltas.items()])
    drawn = drawn_sums(groups, group, [F.col(n) for n in names], draws, seed)
    return whole.crossJoin(F.broadcast(interval(drawn, **deltas)))  # one row beside one row


def family_deltas(rows: DataFrame, group: str) -> DataFrame:
    """Of each group: n, the right answers of a and b, and what b gains."""
    a, b = F.sum(_hits("a", 1)), F.sum(_hits("b", 1))
    return rows.groupBy(group).agg(F.count("*").alias("n"), a.alias("hits_a"), b.alias("hits_b"), ((b - a) / F.count("*")).alias("delta"))


def macro_f1(rows: DataFrame, group: str, classes: list, draws: int, seed: int = 0) -> DataFrame:
    """low, mean, high and draws of the macro-F1 of rows of target and prediction."""
    one = rows.select(group, "target", F.array("prediction").alias("a"))
    stats = [c for x in classes for c in _cells("a", x)]
    names = [f"s{i}" for i in range(len(stats))]
    drawn = drawn_sums(one.groupBy(group).agg(*[F.sum(c).alias(n) for c, n in zip(stats, names, strict=True)]), group, [F.col(n) for n in names], draws, seed)
    m = drawn.select(_macro(F.col("s"), 0, len(classes)).alias("m"))
    return m.agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"), F.count("*").alias("draws"))
