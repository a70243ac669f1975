"""Best-fit packing after Martello-Toth dominance reduction.

``pack_documents`` cuts only documents longer than a sequence, counts pieces by length (at
most ``capacity`` counters reach the driver), packs that histogram and deals the slots out to
the pieces by their rank within their length.  Ranks are taken within (length, salt) groups,
so that a length that many pieces share is spread over tasks.

Null and empty texts hold the end id alone (length 1).  Repeated rows are packed each; rows
of a null doc_id are kept.  Very long texts are cut at each capacity only.  Equal lengths are dealt
out by rank, ties in any order.  Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cmdlake.llm.common import chunks, cut
from cmdlake.llm.vocab import default_path, word_vocab

Pattern = tuple[tuple[int, int], ...]


def dominant_sets(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fix sets that dominate every other set holding their largest item; return them and what is left.

    With item j, room r = capacity - j: a partner of exactly r dominates; if nothing fits, j
    alone does; if no two items fit beside j, the largest single partner does.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    fixed: list[tuple[Pattern, int]] = []

    def take(j: int, k: int) -> int:
        times = left[j] // 2 if j == k else min(left[j], left[k])
        if times:
            fixed.append((((j, 1), (k, 1)), times))
            for n in (j, k):
                left[n] -= times
                if not left[n]:
                    del left[n]
        return times

    again = True
    while again:
        again = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                room = capacity - j
                others = sorted(n for n in left if n <= room and (n != j or left[j] > 1))
                if not others:
                    fixed.append((((j, 1),), 1 if 2 * j <= capacity else left[j]))
                    left[j] -= fixed[-1][1]
                    if not left[j]:
                        del left[j]
                    again = True
                    continue
                low = others[0]
                pair = low + (low if left[low] > 1 + (low == j) else others[1] if len(others) > 1 else capacity)
                if (others[-1] == room or pair > room) and take(j, others[-1]):
                    again = True
                    continue
                break
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over a histogram: equal bins are kept as one pattern with a count."""
    open_: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    done: list[tuple[Pattern, int]] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        (open_[room] if room else done).append((pattern, times)) if times else None

    for n in sorted(counts, reverse=True):
        need = counts[n]
        while need:
            fits = [r for r in open_ if r >= n and open_[r]]
            room = min(fits, default=capacity)
            pattern, bins = open_[room].pop() if fits else ((), need)
            each = room // n
            full = min(bins, need // each)
            put(room - each * n, (*pattern, (n, each)), full)
            need -= full * each
            if full < bins and need:
                put(room - need * n, (*pattern, (n, need)), 1) if need < each else None
                full, need = (full + 1, 0) if need < each else (full, need)
            if fits:
                put(room, pattern, bins - full)
    return done + [x for groups in open_.values() for x in groups]


def slots(packed: list[tuple[Pattern, int]]) -> pd.DataFrame:
    """A row for each length of each pattern: pieces ranked from ``rank`` take its slots, bin by bin."""
    rows, bin_, used = [], 0, defaultdict(int)
    for pattern, times in packed:
        offset = 0
        for n, each in pattern:
            rows.append((n, used[n], bin_, each, offset))
            used[n] += times * each
            offset += n * each
        bin_ += times
    return pd.DataFrame(rows, columns=["length", "rank", "bin", "each", "offset"]).sort_values(["length", "rank"], ignore_index=True)


def pieces(docs: DataFrame, capacity: int, end_id: int, vocab_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids with the end id."""

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = word_vocab(vocab_path or default_path("word_bpe_49k.json"))
        end = np.array([end_id], "<u4").tobytes()
        for pdf in frames:
            texts, keys = pdf["text"].tolist(), pdf["doc_id"].tolist()
            for a, b in chunks(texts):
                out = []
                for key, ids in zip(keys[a:b], vocab.ids_of(texts[a:b]), strict=True):
                    ids += end
                    for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        out.append((key, i, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    # as strings, for pandas would make doubles of whole numbers beside a null
    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(encode, "doc_id string, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocab_path: str | None = None) -> DataFrame:
    """One row per piece with its sequence_id and gapless offset."""
    spark = docs.sparkSession
    cutup = cut(pieces(docs, capacity, end_id, vocab_path))
    full = cutup.filter(F.col("length") == capacity)
    part = cutup.filter(F.col("length") < capacity)
    counts = {r["length"]: r["n"] for r in part.groupBy("length").agg(F.count("*").alias("n")).collect()}
    fixed, rest = dominant_sets(counts, capacity)
    plan = slots(fixed + best_fit(rest, capacity))
    first = {int(n): (g["rank"].to_numpy(), g["bin"].to_numpy(), g["each"].to_numpy(), g["offset"].to_numpy()) for n, g in plan.groupby("length")}

    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = part.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(own) - 1).join(base, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("nth")).drop("base", "nth", "salt")

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rank, length = pdf["rank"].to_numpy(), pdf["length"].to_numpy()
            seq, off = np.zeros(len(pdf), "i8"), np.zeros(len(pdf), "i8")
            for n in np.unique(length):
                of = np.flatnonzero(length == n)
                start, bin_, each, offset = first[int(n)]
                k = np.searchsorted(start, rank[of], "right") - 1
                nth = rank[of] - start[k]
                seq[of] = bin_[k] + nth // each[k]
                off[of] = offset[k] + nth % each[k] * n
            yield pdf.drop(columns="rank").assign(sequence_id=seq, offset=off)

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    dealt = ranked.select(*columns, "rank").mapInPandas(deal, schema)
    # a full piece is a sequence of its own; numbers below zero can't meet those above
    own_seq = full.select(*columns, (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return dealt.unionByName(own_seq).withColumn("doc_id", F.col("doc_id").cast(kind))
