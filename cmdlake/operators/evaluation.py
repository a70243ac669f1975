"""Evaluation aggregates over scored rows: metrics, calibration, thresholds, agreement."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdlake.operators import bootstrap
from cmdlake.operators.ranking import running


def softmax(scores: Column, temperature: Column | float = 1.0) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp((s - top) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def scored(df: DataFrame) -> DataFrame:
    """Adds prediction, confidence, correct, nll and brier to rows of probabilities and a target."""
    p, y = F.col("probabilities"), F.col("target")
    at = F.element_at(p, y.cast("int") + 1)
    squares = F.aggregate(p, F.lit(0.0), lambda a, x: a + x * x)
    return df.withColumns({
        "prediction": (F.array_position(p, F.array_max(p)) - 1).cast("int"),
        "confidence": F.array_max(p),
        "nll": -F.log(F.greatest(at, F.lit(1e-12))),
        "brier": squares - 2 * at + 1,
    }).withColumn("correct", (F.col("prediction") == F.col("target")).cast("double"))


def probability_metrics(df: DataFrame) -> DataFrame:
    """n, accuracy, nll, brier and ten-bin calibration error, in two small aggregations."""
    rows = scored(df).withColumn("bin", F.least(F.floor(F.col("confidence") * 10), F.lit(9)))
    bins = rows.groupBy("bin").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("correct", "confidence", "nll", "brier")])
    n = F.sum("n")
    return bins.agg(
        n.alias("n"), F.round(F.sum("correct") / n, 6).alias("accuracy"), F.round(F.sum("nll") / n, 6).alias("nll"), F.round(F.sum("brier") / n, 6).alias("brier"),
        F.round(F.sum(F.abs(F.col("correct") - F.col("confidence"))) / n, 6).alias("ece"),
    )


def classification_report(df: DataFrame) -> DataFrame:
    """Per class of target and prediction: support, precision, recall, f1; counts come from one confusion table."""
    return _by_class(df).select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _by_class(df: DataFrame) -> DataFrame:
    cells = df.groupBy("target", "prediction").agg(F.count("*").alias("n"))
    ends = cells.select(F.explode(F.array(F.struct(F.col("target").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("target") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("prediction").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    sums = ends.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("hit").alias("hits"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    h = F.col("hits")
    return sums.select(
        "label", "support", safe(h, F.col("predicted")).alias("precision"), safe(h, F.col("support")).alias("recall"),
        safe(2 * h, F.col("support") + F.col("predicted")).alias("f1"),
    )


def temperature_losses(df: DataFrame, grid: list[float]) -> DataFrame:
    """Mean negative log likelihood of rescaled scores at each temperature of a small grid."""
    at = F.explode(F.array(*map(F.lit, grid)))
    rows = df.withColumn("temperature", at)
    p = F.element_at(softmax(F.col("scores"), F.col("temperature")), F.col("target").cast("int") + 1)
    return rows.groupBy("temperature").agg(F.round(F.avg(-F.log(F.greatest(p, F.lit(1e-12)))), 6).alias("nll"))


def best_threshold(df: DataFrame, score: str, target: str) -> DataFrame:
    """threshold and f1: the best F1 over distinct scores, ties to the one nearest one half."""
    by = df.groupBy(score).agg(F.sum(target).alias("pos"), F.count("*").alias("n"))
    run = running(by, score, {"tp": "pos", "said": "n"}).select(F.col(score).alias("threshold"), "tp", "said")
    all_pos = by.agg(F.sum("pos").alias("all_pos"))
    f1 = run.crossJoin(F.broadcast(all_pos)).withColumn("f1", F.round(2 * F.col("tp") / (F.col("said") + F.col("all_pos")), 9))
    return f1.agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.abs(F.col("threshold") - 0.5), "threshold")).alias("x")).select("x.*")


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, share that agrees and Cohen's kappa of two label columns (null if chance agreement is whole)."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = left.join(right, left["a"] == right["b"]).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("met"))
    po, pe = F.col("same") / F.col("total"), F.col("met") / (F.col("total") * F.col("total"))
    return total.crossJoin(chance).select(F.col("total").alias("n"), F.round(po, 6).alias("agreement"), F.when(pe < 1, F.round((po - pe) / (1 - pe), 6)).alias("kappa"))


def ranking_auc(df: DataFrame, score: str, target: str) -> DataFrame:
    """ROC-AUC over distinct scores (ties count half) and average precision; null if a class is missing."""
    by = df.groupBy(score).agg(F.sum(target).alias("pos"), F.count("*").alias("n"))
    run = running(by, score, {"tp": "pos", "said": "n"}).withColumn("neg", F.col("n") - F.col("pos"))
    # a positive outranks every negative of a lower score, and half of those that tie
    pairs = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2))
    precise = F.sum(F.col("pos") * F.col("tp") / F.col("said"))
    return run.agg(pairs.alias("won"), precise.alias("precise"), F.sum("pos").alias("p"), F.sum("neg").alias("m")).select(
        F.when((F.col("p") > 0) & (F.col("m") > 0), F.round(F.col("won") / (F.col("p") * F.col("m")), 6)).alias("roc_auc"),
        F.when((F.col("p") > 0) & (F.col("m") > 0), F.round(F.col("precise") / F.col("p"), 6)).alias("average_precision"),
    )


def error_rates(df: DataFrame, benign: int, classes: list[int]) -> DataFrame:
    """Share of benign rows predicted as each class."""
    own = df.filter(F.col("target") == benign)
    return own.agg(*[F.round(F.avg((F.col("prediction") == c).cast("double")), 6).alias(f"benign_as_{c}") for c in classes])


def group_bootstrap(df: DataFrame, group: str, value: Column, draws: int = 1000, seed: int = 42) -> DataFrame:
    """low, high: 2.5 and 97.5 percent quantiles of the mean when whole groups are drawn anew."""
    sums = df.groupBy(group).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    means = bootstrap.drawn_sums(sums, group, [F.col("s"), F.col("n")], draws, seed)
    return bootstrap.interval(means, mean=F.col("s")[0] / F.col("s")[1]).toDF("low", "high")


def paired_bootstrap(left: DataFrame, right: DataFrame, key: str, group: str, draws: int = 2000, seed: int = 42) -> DataFrame:
    """n, delta, low, high: right's accuracy less left's on the same rows, with 2.5 and 97.5 percent quantiles over drawn groups.

    Both hold key, prediction, target and left the group.  Keys, each once, and targets must be the same on both sides.
    """
    one = F.array("prediction").alias("ranked")
    rows = bootstrap.paired_rows(left.select(key, group, "target", one), right.select(key, "target", one), key, group)
    found = bootstrap.paired_comparison(rows, group, [], (1,), draws, seed)
    return found.select("n", F.col("top1").alias("delta"), F.col("top1_low").alias("low"), F.col("top1_high").alias("high"))


def top_k_rates(df: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """n and the share of rows whose target is among their k likeliest classes, for each k; of equal probabilities the earlier class comes first."""
    own = F.element_at("probabilities", F.col("target").cast("int") + 1)
    ahead = F.size(F.filter("probabilities", lambda p, i: (p > own) | ((p == own) & (i < F.col("target")))))
    return df.agg(F.count("*").alias("n"), *[F.round(F.avg((ahead < k).cast("double")), 6).alias(f"top{k}") for k in ks])


def fitted_temperature(df: DataFrame, low: float = -4.0, high: float = 4.0, rounds: int = 60) -> tuple[float, float, float]:
    """(temperature, loss at 1, loss at it) of rows of scores and a target: the one in [e**low, e**high] of least mean negative log likelihood.

    The loss is convex in the inverse temperature u.  Each round is one aggregate of the loss and its two derivatives at one u; Newton's
    step is taken where it stays between the bounds that the slopes so far have set, and their geometric mean where it
    doesn't.  1 stays if nothing is better; no rows give 1 and no loss.
    """
    z, u_of = F.col("scores"), lambda t: float(np.exp(-t))

    def at(u: float):
        p = softmax(z, 1 / u)
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        mean, own = dot(p, z), F.element_at(z, F.col("target").cast("int") + 1)
        loss = F.avg(-F.log(F.greatest(F.element_at(p, F.col("target").cast("int") + 1), F.lit(1e-12))))
        return df.agg(loss, F.avg(mean - own), F.avg(dot(p, F.transform(z, lambda x: x * x)) - mean * mean)).first()

    least, most, u = u_of(high), u_of(low), 1.0
    before = at(u)
    loss, slope, curve = before
    if loss is None:
        return 1.0, None, None
    for _ in range(rounds):
        least, most = (u, most) if slope < 0 else (least, u)
        step = u - slope / curve if curve > 0 else 0.0
        following = step if least < step < most else float(np.sqrt(least * most))
        done = abs(np.log(following / u)) < 1e-9 or np.log(most / least) < 1e-9
        u = following
        if done:
            break
        loss, slope, curve = at(u)
    return (1 / u, before[0], loss) if loss < before[0] else (1.0, before[0], before[0])


def averaged_report(df: DataFrame) -> DataFrame:
    """average (macro, weighted, micro), precision, recall, f1."""
    r = _by_class(df)
    mean = lambda c, w: F.round(F.sum(F.col(c) * w) / F.sum(w), 6).alias(c)
    rows = [r.agg(*[mean(c, w) for c in ("precision", "recall", "f1")]).select(F.lit(name).alias("average"), "*") for name, w in (("macro", F.lit(1.0)), ("weighted", F.col("support")))]
    hit = F.round(F.avg((F.col("prediction") == F.col("target")).cast("double")), 6)
    micro = df.agg(hit.alias("precision"), hit.alias("recall"), hit.alias("f1")).select(F.lit("micro").alias("average"), "*")
    return rows[0].unionByName(rows[1]).unionByName(micro)


def confusions(df: DataFrame, target: str, prediction: str, most: int = 30) -> DataFrame:
    """The ``most`` frequent pairs of a target and another prediction, and how many rows each has; ties in order of the pair."""
    wrong = df.filter(F.col(target) != F.col(prediction)).groupBy(target, prediction).agg(F.count("*").alias("n"))
    return wrong.orderBy(F.desc("n"), target, prediction).limit(most)
