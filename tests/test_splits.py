"""Splits by group: dealing in bulk is dealing one by one; labels come out even; no group is divided."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cmdlake.operators.digests import multiset_digest
from cmdlake.operators.graph import key_components
from cmdlake.operators.splits import SIDES, dealt_counts, isolated_split


def one_by_one(sizes, times, weights, relative):
    shares = np.array(list(SIDES.values()))
    target = shares[:, None] * (sizes * times[:, None]).sum(0)
    unit = weights / (np.maximum(target, 1) if relative else np.ones_like(target))
    has, out = np.zeros_like(target), []
    for c, m in zip(sizes, times, strict=True):
        x = [0, 0, 0]
        for _ in range(m):
            s = int(np.round((unit * ((has + c - target) ** 2 - (has - target) ** 2)).sum(1), 9).argmin())
            has[s] += c
            x[s] += 1
        out.append(x)
    return out


@pytest.mark.parametrize("relative", [True, False])
def test_bulk_is_one_by_one(relative):
    r = np.random.default_rng(4)
    for _ in range(25):
        k = r.integers(1, 12)
        sizes = np.hstack([np.sort(r.integers(1, 30, size=(k, 1)), 0)[::-1], r.integers(0, 9, size=(k, 2))]).astype(float)
        times, weights = r.integers(1, 60, size=k), np.array([1.0, 2.0, 2.0])
        got = dealt_counts(sizes, times, weights, relative)
        want = np.array(one_by_one(sizes, times, weights, relative))
        assert (np.abs(got - want).max() <= 1) and (got.sum(1) == times).all()
        assert abs((got[:, :, None] * sizes[:, None]).sum(0) - (want[:, :, None] * sizes[:, None]).sum(0)).max() <= 2 * sizes.max()


def test_labels_come_out_even(spark):
    r = random.Random(1)
    rows = []
    for g in range(900):
        rare = g % 30 == 0
        rows += [(g if g else None, "rare" if rare and r.random() < 0.8 else r.choice("ab"), 7) for _ in range(r.choice([1, 1, 1, 2, 3, 9, 40]))]
    df = spark.createDataFrame(rows, "g long, label string, n int")
    for strata in (1, 3):
        out = isolated_split(df, "g", F.array("label"), strata=strata)
        assert out.columns == ["g", "label", "n", "split"] and out.count() == len(rows)
        assert out.groupBy("g").agg(F.countDistinct("split").alias("k")).filter("k <> 1").count() == 0
        by = {(x.label, x.split): x.n for x in out.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
        for label in ("a", "b", "rare"):
            whole = sum(by[label, s] for s in SIDES)
            for s, share in SIDES.items():
                assert abs(by[label, s] - share * whole) <= 40 * strata, (label, s, by)  # a largest group for each stratum


def test_a_hot_group_and_no_rows(spark):
    df = spark.createDataFrame([(1, i) for i in range(500)] + [(i, i) for i in range(2, 502)], "g long, i long")
    n = {(x.split, x.hot): x.n for x in isolated_split(df, "g").groupBy("split", (F.col("g") == 1).alias("hot")).agg(F.count("*").alias("n")).collect()}
    assert n["train", True] == 500 and 280 <= n["train", False] <= 320 and n["test", False] in range(90, 111)
    assert isolated_split(df.filter("g < 0"), "g").count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(200)]
    star = [(1000 + i, "hub" if i % 2 else "", "hub2" if i % 3 == 0 else None) for i in range(300)]
    df = spark.createDataFrame(chain + star + [(5000, None, None)] + chain[:3], "row long, x string, y string")
    got = {r.row: r.component for r in key_components(df, "row", ["x", "y"]).collect()}
    assert {got[i] for i in range(200)} == {0} and got[5000] == 5000
    linked = {i for i in range(300) if i % 2 or i % 3 == 0}
    assert {got[1000 + i] for i in linked} == {1000} and all(got[1000 + i] == 1000 + i for i in range(300) if i not in linked)


def test_digest_knows_no_order(spark):
    one = lambda rows: spark.createDataFrame([(x,) for x in rows], "v string").agg(multiset_digest(F.col("v")).alias("d")).first().d
    assert one(["a", "b", "a", None]) == one(["b", "a", "a"]) != one(["a", "b"]) and one([]) == "0-0-0"
