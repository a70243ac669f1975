"""Queries over scored rows: embeddings stand for raw scores, labels for two reviewers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cmdlake.operators import bootstrap, evaluation

QUERIES, ORACLE = {}, {}
#: Each class takes eight of the 64 components; the first five of them, which a score can't tell from the others, decide the target.
C, SCALE = 8, 6.0
_BLOCK = lambda last: f"list_transform(range(0, {C}), lambda k: list_sum(list_transform(embedding[8 * k + 1 : 8 * k + {last}], lambda x: CAST(x AS DOUBLE))))"
_RAW = f"r AS (SELECT vec_id, list_position({_BLOCK(5)}, list_max({_BLOCK(5)})) - 1 AS target, list_transform({_BLOCK(8)}, lambda x: x * {SCALE}) AS z FROM embeddings)"
SCORED = (
    f"WITH {_RAW}, s AS (SELECT vec_id, target, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM r), "
    "q AS (SELECT vec_id, target, list_transform(e, lambda x: x / list_sum(e)) AS p FROM s), "
    "m AS (SELECT *, list_max(p) AS confidence, list_position(p, list_max(p)) - 1 AS prediction, -ln(greatest(p[target + 1], 1e-12)) AS nll, list_sum(list_transform(p, lambda x: x * x)) - 2 * p[target + 1] + 1 AS brier FROM q) "
)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def raw(spark, sf_dir):
    block = lambda k, n: F.aggregate(F.slice("embedding", 8 * k + 1, n), F.lit(0.0), lambda s, x: s + x.cast("double"))
    few = F.array(*[block(k, 5) for k in range(C)])
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", (F.array_position(few, F.array_max(few)) - 1).alias("target"), F.array(*[block(k, 8) * SCALE for k in range(C)]).alias("scores"))


def rows(spark, sf_dir):
    return raw(spark, sf_dir).withColumn("probabilities", evaluation.softmax(F.col("scores")))


@query(
    SCORED + ", b AS (SELECT least(floor(confidence * 10), 9) AS bin, count(*) AS n, sum(CAST(prediction = target AS INTEGER)) AS c, sum(confidence) AS f, sum(nll) AS l, sum(brier) AS r FROM m GROUP BY 1) "
    "SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(c) / sum(n), 6) AS accuracy, round(sum(l) / sum(n), 6) AS nll, round(sum(r) / sum(n), 6) AS brier, round(sum(abs(c - f)) / sum(n), 6) AS ece FROM b"
)
def eva1_probability_metrics(spark, sf_dir):
    return evaluation.probability_metrics(rows(spark, sf_dir))


GRID = [0.25, 0.5, 1.0, 2.0, 4.0, 8.0]


@query(
    f"WITH t AS (SELECT unnest([{', '.join(map(str, GRID))}]) AS temperature), {_RAW}, s AS (SELECT temperature, target, list_transform(z, lambda x: exp((x - list_max(z)) / temperature)) AS e FROM r CROSS JOIN t) "
    "SELECT CAST(temperature AS DOUBLE) AS temperature, round(avg(-ln(greatest(e[target + 1] / list_sum(e), 1e-12))), 6) AS nll FROM s GROUP BY 1"
)
def eva3_temperature_grid(spark, sf_dir):
    return evaluation.temperature_losses(raw(spark, sf_dir), GRID)


@query(
    SCORED + ", k AS (SELECT DISTINCT target AS label FROM m UNION SELECT prediction FROM m), c AS (SELECT label, (SELECT count(*) FROM m WHERE target = label) AS s, (SELECT count(*) FROM m WHERE prediction = label) AS p, (SELECT count(*) FROM m WHERE prediction = label AND target = label) AS h FROM k) "
    "SELECT CAST(label AS INTEGER) AS label, s AS support, round(CASE WHEN p > 0 THEN h / p ELSE 0.0 END, 6) AS precision, round(CASE WHEN s > 0 THEN h / s ELSE 0.0 END, 6) AS recall, round(CASE WHEN s + p > 0 THEN 2 * h / (s + p) ELSE 0.0 END, 6) AS f1 FROM c"
)
def eva4_classification_report(spark, sf_dir):
    return evaluation.classification_report(evaluation.scored(rows(spark, sf_dir))).withColumn("label", F.col("label").cast("int"))


@query(
    "WITH e AS (SELECT round(value, 0) / 100.0 AS score, CAST(event_type = 'error' AS BIGINT) AS y FROM events), b AS (SELECT score, sum(y) AS pos, count(*) AS n FROM e GROUP BY 1), "
    "r AS (SELECT score AS threshold, sum(pos) OVER w AS tp, sum(n) OVER w AS said, (SELECT sum(pos) FROM b) AS a FROM b WINDOW w AS (ORDER BY score DESC)), "
    "f AS (SELECT threshold, round(2 * tp / (said + a), 9) AS f1 FROM r) SELECT threshold, f1 FROM f ORDER BY f1 DESC, abs(threshold - 0.5), threshold DESC LIMIT 1"
)
def eva8_best_threshold(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.round("value", 0) / 100.0).alias("score"), (F.col("event_type") == "error").cast("long").alias("y"))
    return evaluation.best_threshold(e, "score", "y")


@query(
    "WITH t AS (SELECT count(*) AS n, avg(CAST(quality = toxic AS INTEGER)) AS po FROM labels), x AS (SELECT (SELECT count(*) FROM labels WHERE quality = v) * (SELECT count(*) FROM labels WHERE toxic = v) AS met FROM (SELECT unnest([0, 1]) AS v)), "
    "p AS (SELECT n, po, (SELECT sum(met) FROM x) / (n * n) AS pe FROM t) SELECT n, round(po, 6) AS agreement, CASE WHEN pe < 1 THEN round((po - pe) / (1 - pe), 6) END AS kappa FROM p"
)
def eva12_agreement(spark, sf_dir):
    return evaluation.agreement(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", "toxic")


@query("SELECT event_type, quantile_cont(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95, max(value) AS longest FROM events GROUP BY 1")
def eva15_percentiles(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.max("value").alias("longest"))


_AUC_IN = "WITH e AS (SELECT round(value, 0) AS score, CAST(event_type = 'error' AS BIGINT) AS y FROM events), b AS (SELECT score, sum(y) AS pos, count(*) AS n FROM e GROUP BY 1), "


@query(
    _AUC_IN + "r AS (SELECT *, n - pos AS neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS said FROM b) "
    "SELECT round(sum(neg * (tp - pos + pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc, round(sum(pos * tp / said) / sum(pos), 6) AS average_precision FROM r"
)
def eva6_ranking(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.round("value", 0).alias("score"), (F.col("event_type") == "error").cast("long").alias("y"))
    return evaluation.ranking_auc(e, "score", "y")


@query(SCORED + "SELECT round(avg(CAST(prediction = 0 AS INTEGER)), 6) AS benign_as_0, round(avg(CAST(prediction = 1 AS INTEGER)), 6) AS benign_as_1, round(avg(CAST(prediction = 2 AS INTEGER)), 6) AS benign_as_2 FROM m WHERE target = 0")
def eva7_error_rates(spark, sf_dir):
    return evaluation.error_rates(evaluation.scored(rows(spark, sf_dir)), 0, [0, 1, 2])


@query(
    f"WITH s AS (SELECT user_id, CAST(sum(CAST(event_type = 'error' AS INT)) AS DOUBLE) AS s, count(*) AS n FROM events GROUP BY 1), d AS (SELECT CAST(unnest(range(1, 1001)) AS BIGINT) AS draw), "
    f"w AS (SELECT draw, s, n, {bootstrap.weights_sql('user_id', 42, 'draw')} AS w FROM s CROSS JOIN d), x AS (SELECT draw, sum(w * s) / sum(w * n) AS m FROM w GROUP BY 1) SELECT round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM x"
)
def eva9_group_bootstrap(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    found = evaluation.group_bootstrap(e, "user_id", (F.col("event_type") == "error").cast("double"))
    return found.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


_SLOPE = "(SELECT sum(list_sum(list_transform(z, lambda x: x * exp((x - list_max(z)) * u))) / list_sum(list_transform(z, lambda x: exp((x - list_max(z)) * u))) - z[target + 1]) FROM r)"
_NLL = "(SELECT avg(-ln(greatest(exp((z[target + 1] - list_max(z)) * {0}) / list_sum(list_transform(z, lambda x: exp((x - list_max(z)) * {0}))), 1e-12))) FROM r)"


@query(
    f"WITH RECURSIVE {_RAW}, b(i, low, high, u) AS (SELECT 0, -4.0::DOUBLE, 4.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT i + 1, CASE WHEN s < 0 THEN ln(u) ELSE low END, CASE WHEN s < 0 THEN high ELSE ln(u) END, exp(((CASE WHEN s < 0 THEN ln(u) ELSE low END) + (CASE WHEN s < 0 THEN high ELSE ln(u) END)) / 2) "
    f"FROM (SELECT *, {_SLOPE} AS s FROM b WHERE i < 45)), t AS (SELECT u FROM b ORDER BY i DESC LIMIT 1), l AS (SELECT u, {_NLL.format('1.0')} AS one, {_NLL.format('u')} AS best FROM t) "
    "SELECT round(CASE WHEN best < one THEN 1 / u ELSE 1.0 END, 6) AS temperature, round(one, 6) AS nll_before, round(least(best, one), 6) AS nll_after FROM l"
)
def eva3_fitted_temperature(spark, sf_dir):
    t, before, after = evaluation.fitted_temperature(raw(spark, sf_dir))
    return spark.createDataFrame([(round(t, 6), round(before, 6), round(after, 6))], "temperature double, nll_before double, nll_after double")


@query(
    SCORED + ", k AS (SELECT count(*) AS n, target, prediction FROM m GROUP BY 2, 3), c AS (SELECT label, sum(n) FILTER (target = label) AS s, coalesce(sum(n) FILTER (prediction = label), 0) AS p, coalesce(sum(n) FILTER (target = label AND prediction = label), 0) AS h FROM k, (SELECT DISTINCT unnest([target, prediction]) AS label FROM m) GROUP BY 1), "
    "f AS (SELECT coalesce(s, 0) AS s, CASE WHEN p > 0 THEN h / p ELSE 0.0 END AS pr, CASE WHEN coalesce(s, 0) > 0 THEN h / s ELSE 0.0 END AS re, CASE WHEN coalesce(s, 0) + p > 0 THEN 2 * h / (coalesce(s, 0) + p) ELSE 0.0 END AS f1 FROM c), a AS (SELECT round(avg(CAST(prediction = target AS INT)), 6) AS x FROM m) "
    "SELECT 'macro' AS average, round(avg(pr), 6) AS precision, round(avg(re), 6) AS recall, round(avg(f1), 6) AS f1 FROM f UNION ALL SELECT 'weighted', round(sum(pr * s) / sum(s), 6), round(sum(re * s) / sum(s), 6), round(sum(f1 * s) / sum(s), 6) FROM f UNION ALL SELECT 'micro', x, x, x FROM a"
)
def eva4_averages(spark, sf_dir):
    return evaluation.averaged_report(evaluation.scored(rows(spark, sf_dir)))


@query(SCORED + ", o AS (SELECT len(list_filter(p, lambda x, i: x > p[target + 1] OR (x = p[target + 1] AND i <= target))) AS ahead FROM m) SELECT count(*) AS n, " + ", ".join(f"round(avg(CAST(ahead < {k} AS INT)), 6) AS top{k}" for k in (1, 2, 3)) + " FROM o")
def eva4_top_k(spark, sf_dir):
    return evaluation.top_k_rates(rows(spark, sf_dir), (1, 2, 3))


@query(SCORED + "SELECT target, prediction, count(*) AS n FROM m WHERE target <> prediction GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 30")
def top1_confusions(spark, sf_dir):
    best = F.array_position("probabilities", F.array_max("probabilities")) - 1
    return evaluation.confusions(rows(spark, sf_dir).withColumn("prediction", best), "target", "prediction")
