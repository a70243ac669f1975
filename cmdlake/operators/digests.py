"""Digests of rows: of sets and multisets, which don't depend on order and merge over partitions, and of groups in order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums are taken modulo this prime.
PRIME = (1 << 61) - 1


def multiset_digest(value: Column) -> Column:
    """An aggregate: count and two sums, modulo 2**61 - 1, of independent 60-bit parts of each value's SHA-256; nulls don't count.

    Equal for equal multisets of values in any order; of unlike ones two agree with a probability near 2**-120.
    What a partition holds is three numbers, so that any number of rows merges.
    """
    h = F.sha2(value.cast("string"), 256)
    part = lambda at: F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(20,0)")) % F.lit(PRIME)
    return F.concat_ws("-", F.count(value).cast("string"), *[F.coalesce(part(at).cast("decimal(20,0)").cast("string"), F.lit("0")) for at in (1, 16)])


def multiset_digest_sql(value: str) -> str:
    """The same aggregate as DuckDB SQL."""
    part = lambda at: f"coalesce(sum(CAST('0x' || substr(sha256(CAST({value} AS VARCHAR)), {at}, 15) AS HUGEINT)) % {PRIME}, 0)"
    return f"count({value}) || '-' || {part(1)} || '-' || {part(16)}"


def ordered_digests(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """group (text), n, digest: the SHA-256 of each group's values joined by rising order, then value; null values count but aren't joined.

    A group without a value has a null digest.  One hash goes over a group, so one task reads it, as a sorted stream of
    which it holds a batch; give digests of long values.
    """

    def chained(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, n, state = None, 0, None
        done = lambda: pd.DataFrame([(key, n, state and state.hexdigest())], columns=[group, "n", "digest"])
        for pdf in frames:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            for k, v in zip(pdf[group], pdf[value], strict=True):
                if n and k != key:
                    yield done()
                    n, state = 0, None
                key, n = k, n + 1
                if v is not None:
                    state = state or hashlib.sha256()
                    state.update(v.encode())
        if n:
            yield done()

    text = [F.col(c).cast("string").alias(c) for c in (group, value)]
    dealt = rows.select(*text, order).repartition(group).sortWithinPartitions(group, order, value)
    return dealt.select(group, value).mapInPandas(chained, f"`{group}` string, n long, digest string")
