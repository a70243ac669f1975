"""Exact token counts by length histogram.

Documents are aggregated by encoded length; suffix sums over the histogram (as many rows as
there are distinct lengths, never as many as documents) answer totals, quantiles and
truncated totals for every context limit.

Null and empty texts have length 0.  Repeated rows count each; very long texts are encoded
whole.  Only text is read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cmdlake.llm.common import chunks, cut
from cmdlake.llm.vocab import default_path, word_vocab


def lengths(docs: DataFrame, vocab_path: str | None = None) -> DataFrame:
    """n_tokens of every text."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = word_vocab(vocab_path or default_path("word_bpe_49k.json"))
        for pdf in frames:
            texts = pdf["text"].tolist()
            for a, b in chunks(texts):
                yield pd.DataFrame({"n_tokens": [len(x) // 4 for x in vocab.ids_of(texts[a:b])]})

    return docs.select("text").mapInPandas(count, "n_tokens long")


def length_histogram(docs: DataFrame, vocab_path: str | None = None) -> DataFrame:
    """context_limit (each length that occurs), n_docs of it, and at that limit: n_docs_longer, total_tokens, truncated_tokens, share_whole.

    ``truncated_tokens`` is the corpus total if every document is cut to the limit;
    ``share_whole`` the share of documents that fit, so that the smallest limit with a share
    of q or more is the q-quantile of lengths.
    """
    hist = cut(lengths(docs, vocab_path).groupBy(F.col("n_tokens").alias("context_limit")).agg(F.count("*").alias("n_docs")))
    # block sums first, so that no window holds more than one block of lengths or all blocks
    blocks = hist.withColumn("block", F.floor(F.col("context_limit") / 4096))
    sums = blocks.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("context_limit")).alias("t"))
    up = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    down = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("block", F.coalesce(F.sum("d").over(up), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(down), F.lit(0)).alias("t_before"), F.sum("t").over(Window.partitionBy()).alias("total_tokens"), F.sum("d").over(Window.partitionBy()).alias("all_docs"))
    own = Window.partitionBy("block").orderBy("context_limit")
    longer = F.col("d_after") + F.coalesce(F.sum("n_docs").over(own.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    within = F.col("t_before") + F.sum(F.col("n_docs") * F.col("context_limit")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return (
        blocks.join(sums, "block")
        .select("context_limit", "n_docs", longer.alias("n_docs_longer"), "total_tokens", within.alias("within"), "all_docs")
        .select(
            "context_limit", "n_docs", "n_docs_longer", "total_tokens",
            (F.col("within") + F.col("n_docs_longer") * F.col("context_limit")).alias("truncated_tokens"),
            ((F.col("all_docs") - F.col("n_docs_longer")) / F.col("all_docs")).alias("share_whole"),
        )
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, n_docs_longer, total_tokens, truncated_tokens for any limits, from length_histogram's rows.

    Between two lengths that occur, the documents longer than a limit are those longer than the
    length below it, and each of them adds the difference.
    """
    asked = histogram.sparkSession.createDataFrame([(int(x),) for x in limits], "asked long")
    below = F.max_by(F.struct("context_limit", "n_docs_longer", "truncated_tokens"), F.when(F.col("context_limit") <= F.col("asked"), F.col("context_limit")))
    longer = F.coalesce(F.col("at.n_docs_longer"), F.col("n_docs"))
    return (
        histogram.join(F.broadcast(asked)).groupBy("asked")  # as many rows as limits are given
        .agg(below.alias("at"), F.sum("n_docs").alias("n_docs"), F.max("total_tokens").alias("total_tokens"))
        .select(F.col("asked").alias("context_limit"), longer.alias("n_docs_longer"), "total_tokens", (F.coalesce(F.col("at.truncated_tokens"), F.lit(0)) + longer * (F.col("asked") - F.coalesce(F.col("at.context_limit"), F.lit(0)))).alias("truncated_tokens"))
    )


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """One row, context_limit: the smallest length that at least this share of the documents does not exceed."""
    return histogram.filter(F.col("share_whole") >= share).agg(F.min("context_limit").alias("context_limit"))
