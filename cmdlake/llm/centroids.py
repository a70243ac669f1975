"""Exact centroid clustering over zone maps of Hilbert-ordered vectors.

Vectors become whole numbers, are put in the order of a Hilbert curve over their coordinates along
the directions that tell the first centroids apart, and are packed into blocks with the
least and largest value of every component.  In each round a block's box bounds its distances to
every centroid from both sides; a centroid stays a candidate only if it can be nearest to some point
of the box, and the block's vectors are compared with the candidates alone.  Sums, counts and
distances are whole numbers, so that no result depends on how rows are dealt.

What reaches the driver is one row a centroid: the centroids (k x dim), their sums and counts.

Vectors that are null, of another length, or hold null or non-finite components take no part, nor do
vectors with a component of 2**27 or more after scaling, whose squared distances do not fit a
long.  Repeated rows count each.  With fewer than k vectors there are as many centroids.  A
null id takes part, but becomes a first centroid only after all others; rows of equal ids are
told apart by their components.  An empty table gives no rows.  Other columns are not read, whatever
their names; ids are whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdlake.llm import hilbert
from cmdlake.llm.repeats import written

DIM, K, ROUNDS = 64, 40, 5
SCALE = 256
LARGEST = 1 << 27
#: Rows of a block, axes of the curve and bits of an axis.
BLOCK, AXES, BITS = 256, 8, 8
#: Up to this magnitude, products and sums of doubles are exact.
EXACT = 1 << 22


def whole(embedding: Column, dim: int = DIM) -> Column:
    """floor(256 x) of every component as a double, or null for a vector that takes no part."""
    v = F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    raw = F.transform(embedding, lambda x: x.cast("double") * SCALE)
    fits = F.forall(raw, lambda x: F.coalesce((x < LARGEST) & (x > -LARGEST), F.lit(False)))  # false for null, NaN and infinity
    return F.when((F.size(embedding) == dim) & fits, v)


def kept_vectors(table: DataFrame, dim: int = DIM) -> DataFrame:
    """vec_id and v (array<int>) of the vectors that take part."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding"), dim).alias("v"))
    return rows.filter("v is not null").select("vec_id", F.col("v").cast("array<int>").alias("v"))


def first_centroids(rows: DataFrame, k: int = K) -> np.ndarray:
    order = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    return np.array([r.v for r in rows.orderBy(order.asc_nulls_last(), "v").limit(k).collect()], np.int64)


def directions(centroids: np.ndarray, axes: int = AXES) -> np.ndarray:
    """(dim, axes): the directions along which the centroids spread most."""
    away = centroids - centroids.mean(0)
    return np.linalg.svd(np.vstack([away, np.zeros((1, away.shape[1]))]))[2][:axes].T


def blocks_of(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """ids, vectors (both packed), lo and hi: a row for each block of neighbours on the curve."""
    turn = directions(centroids)
    seen = centroids @ turn
    low, width = seen.min(0) - 1, np.ptp(seen, axis=0) + 2
    dim, types = centroids.shape[1], "vec_id long, v array<int>, key binary"

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v").flatten().to_numpy().reshape(-1, dim)
            # twice as wide as the first centroids lie; what is farther out shares the outermost cell
            cells = np.clip((v @ turn - low + width / 2) / (2 * width) * (1 << BITS), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array([k.tobytes() for k in hilbert.keys(cells.astype(np.int64), BITS)], pa.binary())], ["vec_id", "v", "key"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, n = [], [], 0

        def full(least: int):
            nonlocal ids, vectors, n
            some, v = pa.concat_arrays(ids), np.concatenate(vectors)
            for a in range(0, n - least + 1, BLOCK):
                at = slice(a, a + BLOCK)
                part = v[at]
                cols = [pa.array([some[at].to_pylist()], pa.list_(pa.int64())), pa.array([part.tobytes()], pa.binary()), pa.array([part.min(0).tobytes()], pa.binary()), pa.array([part.max(0).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["ids", "vectors", "lo", "hi"])
            rest = n - n % BLOCK if least == BLOCK else n
            ids, vectors, n = [some[rest:]], [v[rest:]], n - rest

        for b in batches:
            if b.num_rows:
                ids.append(b.column("vec_id"))
                vectors.append(b.column("v").flatten().to_numpy().reshape(-1, dim).astype(np.int32))
                n += b.num_rows
            if n >= 16 * BLOCK:
                yield from full(BLOCK)
        if n:
            yield from full(1)

    # a salt after the key: copies of one vector share a key, and may be a third of all rows
    at = ["key", F.xxhash64("vec_id")]
    return rows.mapInArrow(placed, types).repartitionByRange(*at).sortWithinPartitions(*at).mapInArrow(packed, "ids array<long>, vectors binary, lo binary, hi binary")


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Indices of the centroids that can be nearest to a point of the box.

    First those whose least distance to the box is within the smallest of the largest distances; then, of
    the centroid with that smallest one, those that it doesn't beat at the corner that is worst for it.
    """
    below, above = centroids - lo, hi - centroids
    near = np.maximum(np.maximum(-below, -above), 0)
    far = np.maximum(np.abs(below), np.abs(above))
    least, most = (near * near).sum(1), (far * far).sum(1)
    some = np.flatnonzero(least <= most.min())
    best = centroids[most.argmin()]
    away = centroids[some] - best
    gain = 2 * np.where(away > 0, hi * away, lo * away).sum(1) + (best * best).sum() - (centroids[some] ** 2).sum(1)
    return some[gain >= 0]


def nearest(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of whole vectors (n, dim): the nearest centroid's number (ties: the smaller), the squared distance, and how many centroids were compared."""
    some = candidates(lo, hi, centroids)
    if len(some) == 1:
        away = v - centroids[some[0]]
        return np.full(len(v), some[0]), (away * away).sum(1), 1
    c = centroids[some]
    top = max(np.abs(lo).max(), np.abs(hi).max(), np.abs(c).max())
    a, b = (v.astype(float), c.astype(float)) if top <= EXACT else (v, c)
    d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    at = d.argmin(1)
    return some[at], d[np.arange(len(v)), at].astype(np.int64), len(some)


def _each(batch: pa.RecordBatch, dim: int):
    """ids, whole vectors and box of every block."""
    for ids, v, lo, hi in zip(*(batch.column(i) for i in range(4)), strict=True):
        wide = [np.frombuffer(x.as_buffer(), np.int32).astype(np.int64) for x in (v, lo, hi)]
        yield ids.values, wide[0].reshape(-1, dim), wide[1], wide[2]


def assigned_sums(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, int, list[int]]]:
    """By centroid with vectors: count, sum of distances, comparisons made in its name, and componentwise sums."""
    k, dim = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, dist, total, met = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dim), np.int64), 0
        for b in batches:
            for _, v, lo, hi in _each(b, dim):
                at, d, compared = nearest(v, lo, hi, centroids)
                n += np.bincount(at, minlength=k)
                met += compared * len(v)
                np.add.at(dist, at, d)
                for c in np.unique(at):
                    total[c] += v[at == c].sum(0)
        own = np.flatnonzero(n)
        if len(own):
            arrays = [own, n[own], dist[own], np.where(own == own[0], met, 0)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array(total[own].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "dist", "met", "total"])

    exact = lambda c: F.sum(c.cast("decimal(38,0)"))  # noqa: E731  longs would overflow beyond 2**36 vectors of the largest components
    rows = (
        blocks.mapInArrow(sums, "cluster long, n long, dist long, met long, total array<long>")
        .groupBy("cluster").agg(F.sum("n").alias("n"), exact(F.col("dist")).alias("dist"), F.sum("met").alias("met"), F.array(*[exact(F.col("total")[i]) for i in range(dim)]).alias("total"))
    )
    return {r.cluster: (r.n, int(r.dist), r.met, [int(x) for x in r.total]) for r in rows.collect()}  # k rows at most


def moved(centroids: np.ndarray, sums: dict) -> np.ndarray:
    """Every centroid with vectors at the floor of their mean; the others stay."""
    out = centroids.copy()
    for c, (n, _, _, total) in sums.items():
        out[c] = [x // n for x in total]
    return out


def cluster(table: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256, a row for each vector that takes part."""
    spark, schema = table.sparkSession, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    rows = kept_vectors(table, dim)
    centroids = first_centroids(rows, k)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    blocks = written(blocks_of(rows, centroids))
    for _ in range(rounds):
        centroids = moved(centroids, assigned_sums(blocks, centroids))
    last = assigned_sums(blocks, centroids)
    long = lambda x: x if x < 1 << 63 else None  # noqa: E731  a sum that does not fit is null
    inertia = long(sum(x[1] for x in last.values()))
    of = {c: (long(x[1]), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, x in last.items()}

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, v, lo, hi in _each(b, dim):
                at, d, _ = nearest(v, lo, hi, centroids)
                cols = [ids, pa.array(at, pa.int32()), pa.array(d), pa.array([of[c][0] for c in at], pa.int64()), pa.array([inertia] * len(at), pa.int64()), pa.array([of[c][1] for c in at])]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.mapInArrow(told, schema)
