"""Approximate search by largest inner product over several shifted Hilbert orderings.

Vectors are scaled by the largest norm and given one more component that makes their norms 1 (a
query's is 0), so that a larger inner product is a smaller distance.  Each ordering projects them onto its own
random directions, shifts them, and puts them on a Hilbert curve; Spark range-partitions and sorts
all orderings at once, and neighbours are packed into slices.  A query meets the slices around its own in every
ordering; what its own slices find bounds what the farther ones have to report.  Windows merge by query, and every
reported score is the exact one of the original vectors (correctly rounded sum of their products), so that copies tie.

How many slices a query meets is fitted: ``SAMPLE`` queries are searched exhaustively, and the window
is the narrowest in which the orderings hold a share ``RECALL`` of what was found.  Clustered vectors
need narrow windows.  Directionless noise needs windows that grow with the table, and then work
grows with its square, as for any index.

Equal vectors are one entry, searched once; their ids come back at the end, as many of the smallest as can
be among a query's nearest.  No window or list of ids is capped otherwise.

Vectors that are null, zero, of another length or hold null or non-finite components take no part, nor do rows without an
id.  Rows that repeat id and vector count once; an id with several vectors is a query with each of them and never its
own answer.  Ties go to smaller ids.  An empty table, or one without queries, gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import fsum

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cmdlake.llm import hilbert
from cmdlake.llm.repeats import written

DIM, TOP, EVERY = 64, 20, 20
ORDERINGS, AXES, BITS = 8, 6, 16
#: Rows of a slice.
SLICE = 512
#: Queries searched exhaustively to fit the window, and the share of their neighbours that it has to hold.
SAMPLE, RECALL = 96, 0.95
SEED = 20


def valid(v: Column, dim: int = DIM) -> Column:
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def entries(table: DataFrame, dim: int, every: int, top: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of equal vectors one row: (rep: the smallest id, v, asks: whether a query has it); rep and ids of those with copies; and vec_id and rep of every query."""
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(valid(F.col("v"), dim) & F.col("vec_id").isNotNull())
    rows = rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), (F.pmod("vec_id", F.lit(every)) == 0).alias("asks"))
    groups = written(rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.max("vec_id").alias("last"), F.max("asks").alias("asks"), F.first("v").alias("v")))
    of = groups.select("h1", "h2", "rep", "last")
    named = rows.select("vec_id", "h1", "h2", "asks")
    # the smallest ids of each vector, by salts first: no vector's ids meet in one task before they are few
    few = named.join(of.filter("rep <> last"), ["h1", "h2"]).select("rep", "vec_id").distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for parts in (64, 8):
        few = few.withColumn("salt", F.pmod("salt", F.lit(parts))).withColumn("n", F.row_number().over(Window.partitionBy("rep", "salt").orderBy("vec_id"))).filter(F.col("n") <= top + 1)
    copies = few.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, top + 1).alias("ids"))
    queries = named.filter("asks").join(of, ["h1", "h2"]).select("vec_id", "rep").distinct()
    return groups.select("rep", "v", "asks"), copies, queries


def matrix(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def slices_of(vectors: DataFrame, dim: int, orderings: int, longest: float) -> DataFrame:
    """t, pid, i, reps, vectors, qreps, qvectors: a row a slice, numbered i within the partition pid of the ordering t."""
    r = np.random.default_rng(SEED)
    turns = [np.linalg.qr(r.normal(size=(dim + 1, dim + 1)))[0][:, :AXES] for _ in range(orderings)]
    shifts = r.random((orderings, AXES))
    types = "t int, key binary, role int, rep long, v binary"

    def cells(points: np.ndarray, t: int) -> np.ndarray:
        # projections of unit vectors lie in [-1, 1]; shifted by less than 1, on an axis of 3
        at = (points @ turns[t] + 1 + shifts[t]) / 3
        return np.clip(at * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v, reps, asks = matrix(b, "v", dim), b.column("rep").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            scaled = v / longest
            raw = [x.tobytes() for x in v]
            stored = np.hstack([scaled, np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(1)))[:, None]])
            unit = np.hstack([v[asks] / np.sqrt((scaled[asks] ** 2).sum(1))[:, None] / longest, np.zeros((asks.sum(), 1))])
            for t in range(orderings):
                for role, points, some in ((0, stored, np.arange(len(v))), (1, unit, np.flatnonzero(asks))):
                    keys = [k.tobytes() for k in hilbert.keys(cells(points, t), BITS)]
                    cols = [pa.array(np.full(len(some), t), pa.int32()), pa.array(keys, pa.binary()), pa.array(np.full(len(some), role), pa.int32()), pa.array(reps[some]), pa.array([raw[i] for i in some], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["t", "key", "role", "rep", "v"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, i, held, last = TaskContext.get().partitionId(), 0, [], None

        def one():
            nonlocal i, held
            cols = [pa.array([x], pa.int32()) for x in (last, pid, i)]
            for want in (0, 1):
                side = [(rep, v) for role, rep, v in held if role == want]
                cols += [pa.array([[rep for rep, _ in side]], pa.list_(pa.int64())), pa.array([np.frombuffer(b"".join(v for _, v in side))], pa.list_(pa.float64()))]
            i, held = i + 1, []
            return pa.RecordBatch.from_arrays(cols, ["t", "pid", "i", "reps", "vectors", "qreps", "qvectors"])

        for b in batches:
            for t, role, rep, v in zip(*(b.column(c).to_pylist() for c in ("t", "role", "rep", "v")), strict=True):
                if held and (t != last or len(held) == SLICE):
                    yield one()
                last = t
                held.append((role, rep, v))
        if held:
            yield one()

    at = ["t", "key", "role", "rep"]
    placed_rows = vectors.mapInArrow(placed, types).repartitionByRange(*at).sortWithinPartitions(*at)
    return placed_rows.mapInArrow(packed, "t int, pid int, i int, reps array<long>, vectors array<double>, qreps array<long>, qvectors array<double>")


def numbered(slices: DataFrame) -> DataFrame:
    """slices with s: their place in the ordering.  Slices are counted by task, and tasks are few."""
    counts = sorted((r.t, r.pid, r.n) for r in slices.groupBy("t", "pid").agg(F.count("*").alias("n")).collect())
    starts, at = [], (None, 0)
    for t, pid, n in counts:
        at = at if at[0] == t else (t, 0)
        starts.append((t, pid, at[1]))
        at = (t, at[1] + n)
    first = slices.sparkSession.createDataFrame(starts, "t int, pid int, first int")
    return slices.join(F.broadcast(first), ["t", "pid"]).withColumn("s", F.col("first") + F.col("i"))


def best(scores: np.ndarray, top: int) -> np.ndarray:
    """Of each row, the columns of its largest values, ties and all."""
    if scores.shape[1] <= top:
        return np.ones(scores.shape, bool)
    return scores >= np.partition(scores, -top, axis=1)[:, -top][:, None] - 1e-12 * np.abs(scores).max(1, keepdims=True)


def exact(a: np.ndarray, b: np.ndarray) -> float:
    return fsum((a * b).tolist())


def exhaustive(vectors: DataFrame, sample: list[tuple[int, np.ndarray]], dim: int, top: int) -> DataFrame:
    """rep, other: the sample's nearest of all entries, itself left out."""
    reps, q = np.array([s[0] for s in sample]), np.array([s[1] for s in sample])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        for b in batches:
            if b.num_rows:
                own = b.column("rep").to_numpy()
                now = np.where(own[None] == reps[:, None], -np.inf, q @ matrix(b, "v", dim).T)
                ids, scores = np.hstack([ids, np.broadcast_to(own, now.shape)]), np.hstack([scores, now])
                at = np.argsort(-scores, axis=1, kind="stable")[:, :top]
                ids, scores = np.take_along_axis(ids, at, 1), np.take_along_axis(scores, at, 1)
        some = np.isfinite(scores)
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(reps[:, None], ids.shape)[some]), pa.array(ids[some]), pa.array(scores[some])], ["rep", "other", "score"])

    rows = vectors.select("rep", "v").mapInArrow(found, "rep long, other long, score double")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "other"))).filter(F.col("n") <= top).select("rep", "other")


def fitted_window(slices: DataFrame, vectors: DataFrame, dim: int, top: int, recall: float) -> int:
    """The least number of slices on either side of a query's own in which a share ``recall`` of a sample's neighbours lie, in some ordering."""
    sample = [(r.rep, np.array(r.v)) for r in vectors.filter("asks").orderBy(F.xxhash64("rep")).limit(SAMPLE).select("rep", "v").collect()]
    pairs = [(r.rep, r.other) for r in exhaustive(vectors, sample, dim, top).collect()] if sample else []  # SAMPLE * top at most
    if not pairs:
        return 0
    asked, wanted = np.unique([p[0] for p in pairs]), np.unique([p[1] for p in pairs])

    def seen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for t, s, reps, qreps in zip(pdf["t"], pdf["s"], pdf["reps"], pdf["qreps"], strict=True):
                for role, ids, some in ((0, reps, wanted), (1, qreps, asked)):
                    yield pd.DataFrame({"t": t, "s": s, "role": role, "rep": ids[np.isin(ids, some)]})

    place = {(r.role, r.rep, r.t): r.s for r in slices.select("t", "s", "reps", "qreps").mapInPandas(seen, "t int, s int, role int, rep long").collect()}
    orderings = range(1 + max(t for _, _, t in place))
    away = sorted(min(abs(place[1, q, t] - place[0, c, t]) for t in orderings) for q, c in pairs)
    return away[min(len(away) - 1, int(np.ceil(recall * len(away))) - 1)]


def visited(slices: DataFrame, window: int, dim: int, top: int, bound: DataFrame | None = None) -> DataFrame:
    """rep, other, score: of every query and each slice of its window the nearest entries; with a bound (rep, least), those of them that reach it."""
    at = F.sequence(F.lit(1), F.size("qreps"))
    each = slices.filter(F.size("qreps") > 0).select("t", "s", F.explode(F.transform(at, lambda i: F.struct(F.col("qreps")[i - 1].alias("rep"), F.slice("qvectors", (i - 1) * dim + 1, dim).alias("v")))).alias("q")).select("t", "s", "q.*")
    each = each.withColumn("least", F.lit(float("-inf"))) if bound is None else each.join(bound, "rep")
    # a row a slice again, with as many queries as the slice has
    asking = each.groupBy("t", "s").agg(F.collect_list(F.struct("rep", "least", "v")).alias("q")).select("t", "s", F.col("q.rep").alias("qreps"), F.col("q.least").alias("least"), F.flatten("q.v").alias("qvectors"))
    visits = asking.select(F.col("t").alias("to"), F.explode(F.sequence(F.col("s") - window, F.col("s") + window)).alias("at"), "qreps", "least", "qvectors")

    def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left):
            reps, v = left["reps"][0], left["vectors"][0].reshape(-1, dim)
            for asked, least, qv in zip(right["qreps"], right["least"], right["qvectors"], strict=True):
                q = qv.reshape(-1, dim)
                scores = q @ v.T
                near = best(scores, top) & (scores >= (least - 1e-12 * np.abs(least))[:, None])
                out += [(asked[i], reps[j], exact(q[i], v[j])) for i, j in zip(*np.nonzero(near), strict=True)]
        return pd.DataFrame(out, columns=["rep", "other", "score"])

    held = slices.filter(F.size("reps") > 0).select("t", "s", "reps", "vectors")
    return held.groupBy("t", "s").cogroup(visits.groupBy("to", "at")).applyInPandas(met, "rep long, other long, score double")


def merged(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` nearest of each query over all windows; what several windows found counts once."""
    once = found.dropDuplicates(["rep", "other"])
    return once.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "other"))).filter(F.col("n") <= top)


def search(table: DataFrame, top: int = TOP, every: int = EVERY, dim: int = DIM, orderings: int = ORDERINGS, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score: the nearest found of every row whose id ``every`` divides, its own id left out."""
    vectors, copies, queries = entries(table, dim, every, top)
    longest = vectors.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    if longest is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    slices = written(numbered(written(slices_of(vectors, dim, orderings, longest))))
    window = fitted_window(slices, vectors, dim, top, recall)
    # one more than wanted: a vector is its own neighbour here, which tells how near its copies are
    few = written(merged(visited(slices, 0, dim, top + 1), top + 1))
    if window:
        bound = few.groupBy("rep").agg(F.count("*").alias("n"), F.min("score").alias("least")).select("rep", F.when(F.col("n") > top, F.col("least")).otherwise(float("-inf")).alias("least"))
        few = merged(visited(slices, window, dim, top + 1, bound), top + 1)
    ids = few.join(copies.withColumnRenamed("rep", "other"), "other", "left").select("rep", "score", F.explode(F.coalesce("ids", F.array("other"))).alias("vec_id"))
    ranked = ids.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= top + 1)
    nearest = ranked.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
    own = queries.join(nearest, "rep").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, top).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
