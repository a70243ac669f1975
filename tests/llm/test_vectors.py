"""Centroid clustering and approximate search against brute force, and the curve that both use."""

import hashlib
import math

import numpy as np
import pytest

from cmdlake.llm import centroids, curve_search, hilbert, queries

SF = "/root/testdata/sf0.01"
ROW = "vec_id long, embedding array<float>, v string, t int, key int, n int, rep int, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2, 3, 4, 5) for i, v in rows], ROW)


@pytest.mark.parametrize(("d", "bits"), [(2, 4), (3, 3), (5, 2)])
def test_curve_visits_neighbours(d, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
    k = hilbert.keys(cells, bits)
    order = sorted(range(len(k)), key=lambda i: k[i].tobytes())
    assert len({x.tobytes() for x in k}) == len(cells)
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def lloyd(rows, k, rounds, dim):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(256 * float(np.float32(x))) for x in v]
            if max(map(abs, w)) < 1 << 27:
                kept.append((i, w))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [w for _, w in first[:k]]

    def assign():
        d = [[sum((a - b) ** 2 for a, b in zip(w, x, strict=True)) for x in c] for _, w in kept]
        return [(min(range(len(c)), key=lambda j: (r[j], j)), min(r)) for r in d]

    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            own = [w for (_, w), (a, _) in zip(kept, at, strict=True) if a == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = assign()
    by = {j: sum(d for a, d in at if a == j) for j in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, a, d, by[a], sum(by.values()), sha[a]) for (i, _), (a, d) in zip(kept, at, strict=True)), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_centroids_are_those_of_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(6, 8)) * 3
    v = np.vstack([middle[r.integers(6, size=900)] + r.normal(size=(900, 8)) * 0.05, np.repeat(r.normal(size=(1, 8)), 500, 0), np.round(r.normal(size=(60, 8)))])
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)]
    odd = [[1.0] * 7, [0.0] * 7 + [None], [0.0] * 7 + [math.nan], [math.inf] + [0.0] * 7, None, [], [1e30] * 8]
    rows += [(5000 + i, x) for i, x in enumerate(odd)] + [rows[3], (3, [9.0] * 8), (None, [0.5] * 8), (-4, [-7.0] * 8), (9000, [20000.0] * 8)]
    got = centroids.cluster(table(spark, rows).repartition(5), k=12, rounds=3, dim=8).collect()
    assert sorted((tuple(x) for x in got), key=repr) == lloyd(rows, 12, 3, 8)


def test_few_and_no_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    assert sorted(tuple(x)[:3] for x in centroids.cluster(table(spark, rows), dim=2).collect()) == [(1, 0, 0), (2, 0, 0)]
    assert centroids.cluster(table(spark, []), dim=2).count() == 0 and curve_search.search(table(spark, []), dim=2).count() == 0


def test_boxes_leave_out_only_what_is_never_nearest():
    r = np.random.default_rng(3)
    left_out = 0
    for _ in range(300):
        c = r.integers(-20, 20, size=(15, 3))
        v = r.integers(-20, 20, size=3) + r.integers(-3, 4, size=(40, 3))
        at, d, compared = centroids.nearest(v, v.min(0), v.max(0), c)
        whole = ((v[:, None] - c[None]) ** 2).sum(-1)
        assert (at == whole.argmin(1)).all() and (d == whole.min(1)).all()
        left_out += 15 - compared
    assert left_out > 300 * 5


def nearest(rows, top, dim, every=20):
    kept = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v):
            w = [float(np.float32(x)) for x in v]
            kept[i, tuple(w)] = np.array(w)
    out = {}
    for (i, w), q in kept.items():
        if i % every == 0:
            best = sorted((-math.fsum(q * v), j) for (j, _), v in kept.items() if j != i)[:top]
            out[i, w] = [(j, -s) for s, j in best]
    return out


def test_search_of_a_small_table_is_exact(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(300, 6)) * r.uniform(0.1, 3, size=(300, 1))
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)] + [(1000 + i, v[40].tolist()) for i in range(150)] + [(2000 + i, v[7].tolist()) for i in range(3)]
    rows += [(60, [0.0] * 6), (61, None), (62, [1.0]), (63, [math.nan] * 6), (64, [None] * 6), (None, [1.0] * 6), rows[80], (-20, [0.5, 0.0, -0.0, 1.0, 0.0, 0.0])]
    got = {}
    for x in curve_search.search(table(spark, rows).repartition(3), dim=6).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    want = nearest(rows, 20, 6)
    assert {i for i, _ in want} == set(got)
    for (i, _), near in want.items():
        assert [(j, s) for _, j, s in sorted(got[i])] == near and sorted(n for n, _, _ in got[i]) == list(range(1, 21))


def recall(got, want):
    hits = [len({j for j, _ in near} & got.get(i, set())) for (i, _), near in want.items()]
    return sum(hits) / sum(len(x) for x in want.values())


def test_recall_where_windows_hold_a_part(spark):
    r = np.random.default_rng(6)
    v = np.vstack([r.normal(size=(6000, 16)), r.normal(size=(1, 16)) + r.normal(size=(2500, 16)) * 0.01])
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)]
    got = {}
    for x in curve_search.search(table(spark, rows).repartition(4), dim=16).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    kept = np.array([[float(np.float32(y)) for y in x] for x in v])
    want = {}
    for i in range(0, len(v), 20):
        s = kept @ kept[i]
        s[i] = -np.inf
        want[i, 0] = [(int(j), 0) for j in np.argsort(-s)[:20]]
    assert recall(got, want) >= 0.9 and all(len(x) == 20 for x in got.values())


def test_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op11_centroids(spark, SF).collect()
    assert sorted((tuple(x) for x in got), key=repr) == lloyd(rows, 40, 5, 64)
    found = {}
    for x in queries.op12_curve_search(spark, SF).collect():
        found.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    want = nearest(rows, 20, 64)
    assert recall({i: {j for _, j, _ in x} for i, x in found.items()}, want) >= 0.9
    for (i, _), near in want.items():
        scores = dict(near)
        assert all(s == scores.get(j, s) for _, j, s in found[i])
