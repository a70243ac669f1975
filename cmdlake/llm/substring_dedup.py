"""Substring deduplication of repeated word sequences by a compressed FM-index per shard.

A shard's contexts are indexed by the Burrows-Wheeler transform of their words, kept as a
wavelet matrix of packed bits with block counts.  The contexts are then streamed against it:
a backward search from every window end extends while the match still has a weight of two or
more, which gives the matching statistic of that end up to the threshold.

Null and empty texts have no words.  Repeated rows count as separate texts.  Very long texts are
taken in blocks.  A null doc_id is carried through.  Other columns are not read, whatever their
names.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdlake.llm import repeats

WIDTH, GRAM = 35, 6


class WaveletMatrix:
    """Ranks of symbols in a sequence: per bit level packed bits and counts before each 64-bit word."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.n, self.levels = len(symbols), max(1, int(symbols.max(initial=0)).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate((bit, np.zeros(64 + -len(bit) % 64, bool))), bitorder="little").view("<u8")
            self.bits.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype="i4")[:-1])).astype("i4"))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol occurs before low and before high, less the same start for both."""
        start = np.zeros(len(symbol), "i8")
        for k in range(self.levels):
            one = symbol >> (self.levels - 1 - k) & 1 == 1

            def ones(at: np.ndarray, k: int = k) -> np.ndarray:
                part = self.bits[k][at >> 6] & (np.uint64(1) << (at & 63).astype("u8")) - np.uint64(1)
                return self.before[k][at >> 6] + np.bitwise_count(part)

            a, b, s = ones(low), ones(high), ones(start)
            low = np.where(one, self.zeros[k] + a, low - a)
            high = np.where(one, self.zeros[k] + b, high - b)
            start = np.where(one, self.zeros[k] + s, start - s)
        return low - start, high - start


def repeated(contexts: list[np.ndarray], weights: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each context, which of its windows have a total weight of two or more in the shard."""
    sizes = np.array([len(x) + 1 for x in contexts])
    begin = np.cumsum(sizes) - sizes
    words = np.concatenate([np.concatenate((x, np.zeros(1, "u8"))) for x in contexts])
    names, text = np.unique(words, return_inverse=True)
    text = text.astype("i8") + 1
    text[begin + sizes - 1] = 0
    order = repeats.ranked(text, width)
    matrix = WaveletMatrix(text[order - 1])
    less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(names) + 2))))
    weight = np.repeat(weights, sizes).astype("i8")
    # a match's weight: that of the places where it starts, in suffix order
    summed = np.concatenate(([0], np.cumsum(weight[order])))
    hit = np.zeros(len(text), bool)
    last = np.ones(len(text), bool)
    for b, s in zip(begin, sizes, strict=True):
        last[b : b + width - 1] = last[b + s - 1] = False
    at = np.flatnonzero(last)
    low, high = np.zeros(len(at), "i8"), np.full(len(at), len(text), "i8")
    for step in range(width):
        symbol = text[at - step]
        a, b = matrix.rank(symbol, low, high)
        low, high = less[symbol] + a, less[symbol] + b
        on = summed[high] - summed[low] >= 2
        at, low, high = at[on], low[on], high[on]
        if not len(at):
            break
    hit[at - width + 1] = True
    return [hit[b : b + s - width] for b, s in zip(begin, sizes, strict=True)]


def _slices(raw: bytes, at: list[tuple[int, int]]) -> list[bytes]:
    words = repeats.word_symbols([raw])[0].astype("<u8")
    return [words[a : a + n].tobytes() for a, n in at]


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with keep_text also kept, the remaining words joined by a space."""
    spans = repeats.repeated_windows(docs, repeats.word_symbols, _slices, lambda x, w: repeated(x, w, width), width, gram, 8)
    schema = "d long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for d, text, found in zip(pdf["d"], pdf["text"], pdf["spans"], strict=True):
                words, gone = text.encode().split(), 0
                n = len(words)
                if found is not None:
                    away = repeats.covered(found, n, width)
                    words, gone = [w for w, x in zip(words, away.tolist(), strict=True) if not x], int(away.sum())
                kept = b" ".join(words)
                out.append((d, n, gone, hashlib.sha256(kept).hexdigest(), *[kept.decode()] * keep_text))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in schema.split(", ")])

    done = repeats.keyed(docs).join(spans, ["d", "k"], "left").select("d", "text", "spans").mapInPandas(apply, schema)
    return done.select(F.when(F.col("d") != repeats.NONE, F.col("d")).alias("doc_id"), *[c for c in done.columns if c != "d"])
