"""Paired bootstrap and averaged metrics."""

import pytest

from cmdlake.operators import evaluation


def test_paired_bootstrap(spark):
    left = [(i, i % 20, 1, int(i % 2 == 0)) for i in range(400)]
    right = [(i, i % 20, 1, int(i % 4 != 3)) for i in range(400)]
    schema = "k long, g long, target int, prediction int"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    x = evaluation.paired_bootstrap(a, b, "k", "g").first()
    assert (x.n, x.delta) == (400, 0.25) and 0.0 < x.low < 0.25 < x.high < 0.6
    assert evaluation.paired_bootstrap(a, b, "k", "g").first() == x
    with pytest.raises(Exception, match="differ"):
        evaluation.paired_bootstrap(a, b.filter("k > 0"), "k", "g").collect()


def test_averages(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1)], "target int, prediction int")
    got = {r.average: (r.precision, r.recall, r.f1) for r in evaluation.averaged_report(df).collect()}
    assert got == {"macro": (0.75, pytest.approx(0.833333, abs=1e-6), pytest.approx(0.733333, abs=1e-5)), "weighted": (0.875, 0.75, pytest.approx(0.766667, abs=1e-5)), "micro": (0.75, 0.75, 0.75)}
