"""Suffix-array deduplication of repeated byte strings.

Within a shard the contexts' suffixes are ordered to the threshold, the Burrows-Wheeler
transform is read off, and intervals of common prefixes are found by increasing length: each
round extends the intervals that are new by every byte that precedes them, marks where the
longer intervals begin, and stops at the threshold.  Suffixes between two marks then share
the threshold's bytes.

Null and empty texts lose nothing.  Repeated rows count as separate texts, so a text of at
least ``width`` bytes that occurs twice loses all.  Very long texts are taken in blocks.  A null
doc_id is carried through.  Other columns are not read, whatever their names.  An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdlake.llm import repeats
from cmdlake.llm.common import fresh

WIDTH, GRAM = 200, 24


def interval_starts(bwt: np.ndarray, depth: int) -> np.ndarray:
    """Where, in suffix order, the common prefix with the suffix before is shorter than ``depth``."""
    n = len(bwt)
    order = np.argsort(bwt.astype("u2"), kind="stable")
    forward = np.empty(n, "i8")
    forward[order] = np.arange(n)  # place of the suffix one symbol longer
    known = np.zeros(n, bool)
    low, high = np.zeros(1, "i8"), np.full(1, n - 1, "i8")
    for _ in range(depth):
        single = low == high
        start, end = [forward[low[single]]], [forward[low[single]]]
        lo, size = low[~single], (high - low)[~single] + 1
        if len(lo):
            which = np.repeat(np.arange(len(lo)), size)
            place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
            # within an interval, places of longer suffixes ascend by byte and then as before
            by = np.argsort(which << 32 | forward[place])
            byte, of = bwt[place[by]], which[by]
            first = np.flatnonzero(np.concatenate(([True], (byte[1:] != byte[:-1]) | (of[1:] != of[:-1]))))
            last = np.concatenate((first[1:], [len(by)])) - 1
            start.append(forward[place[by[first]]])
            end.append(forward[place[by[last]]])
        low, high = np.concatenate(start), np.concatenate(end)
        new = ~known[low]
        low, high = low[new], high[new]
        known[low] = True
        if not len(low):
            break
    return known


def repeated(contexts: list[np.ndarray], weights: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each context, which of its windows have a total weight of two or more in the shard."""
    text = np.concatenate([np.concatenate((x.astype("i4") + 1, [0])) for x in contexts])
    order = repeats.ranked(text, width)
    starts = interval_starts(text[order - 1], width)
    group = np.empty(len(text), "i8")
    group[order] = np.cumsum(starts)
    sizes = np.array([len(x) + 1 for x in contexts])
    begin = np.cumsum(sizes) - sizes
    whole = np.zeros(len(text))
    for b, s, w in zip(begin, sizes, weights, strict=True):
        whole[b : b + s - width] = w
    total = np.bincount(group, whole)
    hit = total[group] >= 2
    return [hit[b : b + s - width] for b, s in zip(begin, sizes, strict=True)]


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """d, k and spans of repeated windows (see repeats.repeated_windows)."""
    return repeats.repeated_windows(
        docs, repeats.byte_symbols, lambda raw, at: [raw[a : a + n] for a, n in at], lambda x, w: repeated(x, w, width), width, gram, 1
    )


def remaining_text(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """The documents with text cut to what remains; bytes of characters that a removal divides go too."""

    @F.pandas_udf("string")
    def rest(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(text, spans, strict=True):
            if found is not None and t is not None:
                raw = np.frombuffer(t.encode(), "u1")
                t = raw[~repeats.covered(found, len(raw), width)].tobytes().decode("utf-8", "ignore")
            out.append(t)
        return pd.Series(out, dtype=object)

    d, k, found = fresh(docs, "d", "k", "spans")
    named = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(repeats.NONE)), k: F.xxhash64("doc_id", "text")})
    done = named.join(repeated_spans(docs, width, gram).toDF(d, k, found), [d, k], "left").withColumn("text", rest("text", found))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with keep_text also kept, the remaining bytes."""
    spans = repeated_spans(docs, width, gram)
    schema = "d long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for d, text, found in zip(pdf["d"], pdf["text"], pdf["spans"], strict=True):
                raw = text.encode()
                kept, gone, n = raw, 0, 0
                if found is not None:
                    away = repeats.covered(found, len(raw), width)
                    kept = np.frombuffer(raw, "u1")[~away].tobytes()
                    gone, n = int(away.sum()), len(repeats.true_runs(away))
                out.append((d, len(raw), gone, n, hashlib.sha256(kept).hexdigest(), *[kept] * keep_text))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in schema.split(", ")])

    done = repeats.keyed(docs).join(spans, ["d", "k"], "left").select("d", "text", "spans").mapInPandas(apply, schema)
    return done.select(F.when(F.col("d") != repeats.NONE, F.col("d")).alias("doc_id"), *[c for c in done.columns if c != "d"])
