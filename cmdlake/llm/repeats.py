"""Repeated windows of a fixed width over whole texts: routing that brings equal windows together.

Every window of ``width`` symbols is named by its anchor, the ``gram``-symbol string in it
with the smallest hash, so equal windows have equal anchors at equal places.  Consecutive
windows under one anchor form a run; a run's context is the text its windows span.  Anchors of
a single run end there.  Runs of the others are counted by (anchor, context) with map-side
combining, so copies collapse to one context with a weight.  Equal windows of two
contexts agree on half the window's rest to the left of the anchor or to its right, so a
context that shares neither half with another has only the copies of itself.  The text of the
rest goes, by anchor, to shards, where an index (a function given by the caller) finds the
windows whose weight is two or more.  An anchor with more than ``crowded`` such contexts would
make a shard too large: its windows are counted one by one instead, as an ordinary grouped
count.

Hashes have 64 bits and contexts are compared by anchor and context hash together.  A byte's
symbol mixes it with the seven that follow, and a word's symbol is a keyed hash of the word, so
that no regular pattern of letters makes two sums of symbols agree.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdlake.llm.common import checkpoint_dir

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
NONE = -(2**63)
CROWDED, SHARD_SYMBOLS = 10_000, 1_200_000
#: Window starts taken at once; positions have 24 bits.
BLOCK = 1 << 22
#: Bytes that one byte's symbol is made of.
AHEAD = 8


def mixed(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit value of each 64-bit value."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def substring_hasher(symbols: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of (start, end) arrays: a hash of each symbols[start:end], equal for equal strings wherever they stand."""
    up = np.full(len(symbols) + 1, BASE, "u8")
    up[0] = 1
    up = np.cumprod(up, dtype="u8")
    down = np.full(len(symbols) + 1, INVERSE, "u8")
    down[0] = 1
    down = np.cumprod(down, dtype="u8")
    total = np.concatenate((np.zeros(1, "u8"), np.cumsum(symbols * up[:-1], dtype="u8")))

    def hash_of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((total[end] - total[start]) * down[start] + (end - start).astype("u8") * np.uint64(0xD6E8FEB86659FD93))

    return hash_of


def substring_hashes(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return substring_hasher(symbols)(start, end)


def byte_symbols(raw: list[bytes], ahead: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the joined byte strings, each of ``ahead`` (up to 8) bytes, and where each string starts."""
    joined = b"".join(raw)
    eight = np.ndarray((len(joined),), "<u8", joined + bytes(8), strides=(1,))
    part = eight & np.uint64(256**ahead - 1)
    return mixed(part + np.uint64(BASE)), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype("i8")


def word_symbols(raw: list[bytes], ahead: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """A keyed hash for each word of the joined texts and where each text's words start."""
    words = [x.split() for x in raw]
    flat = np.fromiter(chain.from_iterable(words), object, sum(map(len, words)))
    return pd.util.hash_array(flat, categorize=False), np.concatenate(([0], np.cumsum([len(x) for x in words]))).astype("i8")


def runs(symbols: np.ndarray, starts: np.ndarray, width: int, gram: int, ahead: int = 1, block: int = BLOCK) -> tuple[np.ndarray, ...]:
    """Of each run: text number, first window (within its text), windows, anchor hash, context hash,
    and hashes of the half left and the half right of the anchor (0: the run doesn't reach so far).

    Symbols are taken in blocks of window starts; a run that a block's end divides is two runs.
    """
    parts = [
        _block_runs(symbols[b : b + block + width - 1], np.clip(starts - b, 0, min(block + width - 1, len(symbols) - b)), width, gram, ahead - 1)
        for b in range(0, max(len(symbols), 1), block)
    ]
    for i, part in enumerate(parts):  # a text that began in an earlier block
        part[1] += np.maximum(0, i * block - starts[:-1])[part[0]]
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(7))


def _block_runs(symbols: np.ndarray, starts: np.ndarray, width: int, gram: int, less: int) -> list[np.ndarray]:
    n, w, half = len(symbols), width - gram + 1, (width - gram) // 2
    empty = np.zeros(0, "i8")
    if n < width:
        return [empty] * 7
    hash_of = substring_hasher(symbols)
    at = np.arange(n - gram + 1)
    hashes = hash_of(at, at + gram - less)
    key = mixed(hashes) >> np.uint64(24) << np.uint64(24) | at.astype("u8")
    span = 1
    while 2 * span <= w:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < w:
        key = np.minimum(key[: len(key) - (w - span)], key[w - span :])
    sizes = np.diff(starts)
    valid = np.zeros(n + 1, "i4")
    long_ = sizes >= width
    np.add.at(valid, starts[:-1][long_], 1)
    np.add.at(valid, starts[1:][long_] - width + 1, -1)
    window = np.flatnonzero(np.cumsum(valid)[: len(key)])
    if not len(window):
        return [empty] * 7
    anchor = (key[window] & np.uint64(0xFFFFFF)).astype("i8")
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    count = np.diff(np.concatenate((first, [len(window)])))
    begin = window[first]
    text = np.searchsorted(starts, begin, "right") - 1
    end, core = begin + count - 1 + width, anchor[first]
    # a half goes along with the anchor, so that it is never shorter than a symbol reaches
    left = np.where(core - half >= begin, hash_of(np.maximum(core - half, 0), core + gram - less) | np.uint64(1), np.uint64(0))
    right = np.where(core + gram + half <= end, hash_of(core, np.minimum(core + gram + half, n) - less) | np.uint64(1), np.uint64(0))
    return [text, begin - starts[text], count, hashes[core].view("i8"), hash_of(begin, end - less).view("i8"), left.astype("u4").view("i4"), right.astype("u4").view("i4")]


def keyed(docs: DataFrame) -> DataFrame:
    """d, k (a key of equal rows) and text."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("d"), F.xxhash64("doc_id", "text").alias("k"), F.coalesce("text", F.lit("")).alias("text")
    )


def batches(pdf: pd.DataFrame, size: int = 1 << 21) -> Iterator[pd.DataFrame]:
    """Slices of about so many bytes of text; a longer text stands alone."""
    total = np.cumsum(pdf["text"].str.len().to_numpy()) // size
    for _, part in pdf.groupby(total, sort=False):
        yield part


def find_runs(docs: DataFrame, symbols_of: Callable, width: int, gram: int) -> DataFrame:
    ahead = min(AHEAD, gram) if symbols_of is byte_symbols else 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part in batches(pdf):
                symbols, starts = symbols_of([t.encode() for t in part["text"]], ahead)
                text, at, n, h, c, left, right = runs(symbols, starts, width, gram, ahead)
                yield pd.DataFrame({"h": h, "c": c, "d": part["d"].to_numpy()[text], "k": part["k"].to_numpy()[text], "at": at, "n": n, "l": left, "r": right})

    return keyed(docs).mapInPandas(run, "h long, c long, d long, k long, at long, n long, l int, r int")


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder: columnar, so smaller than checkpoint()."""
    path = f"{checkpoint_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() that no later step reads."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            found = jvm.org.apache.hadoop.fs.Path(path)
            found.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def repeated_windows(docs: DataFrame, symbols_of: Callable, slices_of: Callable, index: Callable, width: int, gram: int, symbol_bytes: int, crowded: int = CROWDED, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """d, k, spans: sorted array of (first window, past-last window) whose string starts elsewhere too.

    slices_of(text, at, n) gives the bytes of a context; index(symbol arrays, weights) a list
    of boolean arrays, one value per window of each context.
    """
    found = written(find_runs(docs, symbols_of, width, gram))
    # most anchors stand once: their runs end here, told by a count that moves the anchors alone
    again = found.groupBy("h").agg(F.count("*").alias("total")).filter("total > 1").select("h")
    near = written(found.join(again.hint("merge"), "h", "left_semi"))
    discard(found)
    contexts = near.groupBy("h", "c").agg(F.count("*").alias("weight"), F.min(F.struct("d", "k", "at", "n", "l", "r")).alias("one"))
    anchors = contexts.groupBy("h").agg(F.count("*").alias("contexts"))
    contexts = written(contexts.join(anchors.hint("merge"), "h").select("h", "c", "weight", "contexts", "one.*"))

    # contexts that share a half with another one of their anchor
    halves = (
        contexts.filter("contexts > 1")
        .select("h", "c", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("l").alias("half")), F.struct(F.lit(1).alias("side"), F.col("r").alias("half")))).alias("x"))
        .select("h", "c", "x.*").filter("half <> 0")
    )
    shared = halves.groupBy("h", "side", "half").agg(F.count("*").alias("m")).filter("m > 1").drop("m")
    meet = halves.join(shared.hint("merge"), ["h", "side", "half"]).select("h", "c").distinct()
    several = contexts.join(meet.hint("merge"), ["h", "c"])
    several = written(several.join(several.groupBy("h").agg(F.count("*").alias("m")).hint("merge"), "h").select("h", "c", "d", "k", "at", "n", "weight", F.col("m").alias("contexts")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("n").alias("e"))).alias("spans")
    alone = contexts.filter("weight > 1").select("h", "c", whole)

    # contexts' text: one row per document that holds any
    wanted = several.groupBy("d", "k").agg(F.collect_list(F.struct("h", "c", "weight", "contexts", "at", "n")).alias("parts"))

    def pull(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part in batches(pdf, 1 << 22):
                out = []
                for text, parts in zip(part["text"], part["parts"], strict=True):
                    cut_ = slices_of(text.encode(), [(p["at"], p["n"] - 1 + width) for p in parts])
                    out += [(p["h"], p["c"], p["weight"], p["contexts"], s) for p, s in zip(parts, cut_, strict=True)]
                yield pd.DataFrame(out, columns=["h", "c", "weight", "contexts", "body"])

    once = keyed(docs).dropDuplicates(["d", "k"])  # equal rows are one row here, so no context is pulled twice
    pulled = once.join(wanted, ["d", "k"]).select("text", "parts").mapInPandas(pull, "h long, c long, weight long, contexts long, body binary")
    pulled = written(pulled)
    size = pulled.filter(F.col("contexts") <= crowded).agg(F.sum(F.octet_length("body"))).first()[0] or 0
    shards = int(size // (symbol_bytes * shard_symbols)) + 1

    dtype = "u1" if symbol_bytes == 1 else "<u8"

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        hits = index([np.frombuffer(b, dtype) for b in pdf["body"]], pdf["weight"].to_numpy())
        # copies of a context are all marked already
        spans = [[{"s": int(s), "e": int(e)} for s, e in true_runs(x)] if w == 1 else [] for x, w in zip(hits, pdf["weight"], strict=True)]
        return pd.DataFrame({"h": pdf["h"], "c": pdf["c"], "spans": spans})[[bool(x) for x in spans]]

    indexed = (
        pulled.filter(F.col("contexts") <= crowded)
        .withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
        .groupBy("shard").applyInPandas(search, "h long, c long, spans array<struct<s: long, e: long>>")
    )

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ahead = min(AHEAD, width) if symbol_bytes == 1 else 1
        for pdf in frames:
            for h, c, weight, body in zip(pdf["h"], pdf["c"], pdf["weight"], pdf["body"], strict=True):
                x = byte_symbols([body], ahead)[0] if symbol_bytes == 1 else np.frombuffer(body, dtype).astype("u8")
                at = np.arange(len(x) - width + 1)
                yield pd.DataFrame({"h": h, "c": c, "weight": weight, "w": substring_hashes(x, at, at + width - ahead + 1).view("i8"), "at": at})

    each = pulled.filter(F.col("contexts") > crowded).mapInPandas(windows, "h long, c long, weight long, w long, at long")
    twice = each.groupBy("h", "w").agg(F.sum("weight").alias("total")).filter("total > 1").select("h", "w")
    counted = (
        each.filter("weight = 1").join(twice, ["h", "w"]).groupBy("h", "c")
        .agg(F.collect_set(F.struct(F.col("at").alias("s"), (F.col("at") + 1).alias("e"))).alias("spans"))
    )
    verdicts = written(alone.unionByName(indexed).unionByName(counted))
    discard(contexts, several, pulled)
    spans = written(
        near.join(verdicts, ["h", "c"])
        .select("d", "k", "at", F.explode("spans").alias("x"))
        .groupBy("d", "k").agg(F.array_sort(F.collect_list(F.struct((F.col("at") + F.col("x.s")).alias("s"), (F.col("at") + F.col("x.e")).alias("e")))).alias("spans"))
    )
    discard(near, verdicts)
    return spans


def true_runs(hit: np.ndarray) -> np.ndarray:
    """(start, end) of the maximal runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype("i1"), [0]))))
    return edge.reshape(-1, 2)


def covered(spans: list | None, length: int, width: int) -> np.ndarray:
    """Which of the text's symbols a repeated window covers."""
    edge = np.zeros(length + 1, "i4")
    for x in spans if spans is not None else ():
        edge[x["s"]] += 1
        edge[min(length, x["e"] - 1 + width)] -= 1
    return np.cumsum(edge)[:length] > 0


def ranked(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes by their first ``depth`` symbols at least.

    A first sort takes as many symbols as 64 bits hold; then the compared length doubles, and
    only suffixes that still tie are sorted again.  Ranks are places of the first of a tie.
    """
    n, bits = len(symbols), max(1, int(symbols.max(initial=0)).bit_length())
    reach = max(1, min(depth, 63 // bits))
    key = np.zeros(n, "u8")
    for k in range(reach):
        key <<= np.uint64(bits)
        key[: max(0, n - k)] |= symbols[k:].astype("u8")
    order = np.argsort(key)
    head = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank = np.empty(n, "u8")
    place = np.arange(n, dtype="u8")
    rank[order] = np.maximum.accumulate(np.where(head, place, 0))
    while reach < depth:
        tied = np.flatnonzero(~(head & np.concatenate((head[1:], [True]))))
        if not len(tied):
            break
        at = order[tied]
        after = at + reach
        key = rank[at] << np.uint64(32)
        inside = after < n
        key[inside] |= rank[after[inside]] + np.uint64(1)
        by = np.argsort(key)
        order[tied], key = at[by], key[by]
        head[tied] = np.concatenate(([True], key[1:] != key[:-1]))
        rank[order[tied]] = np.maximum.accumulate(np.where(head[tied], tied, 0)).astype("u8")
        reach *= 2
    return order
