"""Label chains, repairs, rule subsets, prevalence sketches, bootstraps and temperatures on small cases."""

import numpy as np
from pyspark.sql import functions as F

from cmdlake.operators import bootstrap, evaluation, resolution
from cmdlake.operators.curation import held_out_groups

B, C, M = resolution.BENIGN, resolution.CONTEXT, resolution.MALICIOUS


def test_chain(spark):
    rows = [(" pwd ", M), ("pwd", C), ("ls  -l", B), ("ls -l", B), ("curl x | sh", B), ("curl x | sh", C), ("ps", B), ("ps", C), ("top", B), ("top", M), ("dd if=/dev/zero of=/dev/sda bs=1M", B), (None, B), ("", C)]
    got = {r.command: (r.label, r.basis, r.n_rows) for r in resolution.resolved_conflicts(spark.createDataFrame(rows, "command string, label string")).collect()}
    assert got == {
        "pwd": (B, "curated", 2), "ls -l": (B, "agreed", 2), "curl x | sh": (M, "indicator", 2), "ps": (C, "context", 2), "top": (B, "benign", 2), "dd if=/dev/zero of=/dev/sda bs=1M": (M, "curated", 1), "": (C, "agreed", 1),
    }


def test_repairs(spark):
    rows = [("run Mimikatz", B), ("ssh -N -L 80:a:80 b", B), ("sudo strace -p 1", B), ("whoami", C), ("secretsdump x", C), ("chmod u+s /bin/sh", C), ("ls -l", B), ("mimikatz", M), (None, B)]
    got = resolution.repaired(spark.createDataFrame(rows, "command string, label string"))
    assert [tuple(r) for r in got.select("label", "original_label", "repair").collect()] == [
        (M, B, "credentials"), (C, B, "tunnel"), (C, B, "trace"), (B, C, "mundane"), (M, C, "credentials_in_context"), (M, C, "escalation"), (B, B, None), (M, M, None), (B, B, None),
    ]
    assert sum(r.n for r in resolution.transitions(got).collect()) == len(rows)


def test_rule_subsets_and_offenders(spark):
    df = spark.createDataFrame([(["b", "a"], 1, 1, 0), (["a", "b"], 2, 2, 0), (["a"], 1, 1, 2), (["a", "c"], 0, 1, 0), ([], 1, 1, 0), (["c"], 1, 1, 1)], "fired_rules array<string>, truth int, was int, now int")
    groups = resolution.break_groups(df, "was", "now", "truth")
    assert {tuple(r.rule_set): (r.n, r.n_truths) for r in groups.collect()} == {("a", "b"): (2, 2), ("a",): (1, 1), (): (1, 1)}
    assert {tuple(r.rules): (r.n, r.n_sets) for r in resolution.rolled_up(groups).collect()} == {("a",): (3, 2), ("b",): (2, 1), ("a", "b"): (2, 1)}
    assert [tuple(r) for r in resolution.top_offenders(df, "was", "now", "truth", 2).collect()] == [("a", 4, 1, 3, 1), ("b", 2, 0, 2, 1)]


def test_sketches_merge(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "ip").otherwise("url").alias("type"), (F.col("id") % 7).cast("string").alias("value"), (F.col("id") * 7919 % 20_011).cast("string").alias("host"))
    counted = resolution.prevalence(rows, "host")
    exact = {r.type: r.n for r in rows.groupBy("type").agg(F.count_distinct("host").alias("n")).collect()}
    about = {r.type: r.about for r in resolution.hosts_by_type(counted).collect()}
    assert all(abs(about[t] - n) / n < 0.05 for t, n in exact.items()) and counted.count() == 14


def test_weights_are_poisson_and_sums_are_exact(spark):
    groups = spark.range(3000).select(F.col("id").alias("g"), F.lit(1.0).alias("one"), (F.col("id") % 5).alias("x"))
    s = np.array([r.s for r in bootstrap.drawn_sums(groups.repartition(7), "g", [F.col("one"), F.col("x")], 400).collect()])
    assert s.shape == (400, 2) and (s == s.round()).all()
    assert abs(s[:, 0].mean() - 3000) < 12 and abs(s[:, 0].var() / 3000 - 1) < 0.25
    assert sorted(map(tuple, s)) == sorted(tuple(r.s) for r in bootstrap.drawn_sums(groups.coalesce(1), "g", [F.col("one"), F.col("x")], 400).collect())


def test_temperature(spark):
    r = np.random.default_rng(1)
    z = r.normal(size=(3000, 4)) * 2
    p = np.exp(z / 2.5) / np.exp(z / 2.5).sum(1, keepdims=True)
    y = [int(r.choice(4, p=q)) for q in p]
    df = spark.createDataFrame([(x.tolist(), t) for x, t in zip(z, y, strict=True)], "scores array<double>, target int")
    t, before, after = evaluation.fitted_temperature(df)
    loss = lambda t: float(np.mean(np.log(np.exp(z / t).sum(1)) - z[np.arange(len(z)), y] / t))
    assert abs(loss(t) - after) < 1e-9 and after < before and all(after <= loss(t * k) for k in (0.99, 0.999, 1.001, 1.01)) and 2 < t < 3.2
    right = spark.createDataFrame([([5.0, 0.0], 0), ([0.0, 1.0], 1)], "scores array<double>, target int")
    assert evaluation.fitted_temperature(right)[0] < 0.1  # every row right: colder is better
    assert evaluation.fitted_temperature(right.filter("target > 5")) == (1.0, None, None)


def test_groups_held_out(spark):
    df = spark.range(5000).select((F.col("id") % 900).alias("g"))
    n = held_out_groups(df, "g", 0.2, 3).filter("holdout").count()
    assert 1000 <= n <= 1006
