"""Learning on command texts: TF-IDF of character and word n-grams, calibrated linear models, folds by group, a forest.

Every step is a Spark ML estimator or an expression; vocabularies are bounded by their parameter, as the model's size is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENS = r"[a-z0-9_./:\\$%@=+-]+"


def grams(items: Column, low: int, high: int, between: str = "") -> Column:
    """All runs of low to high neighbours in an array."""
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.size(items) - n + 1), lambda i: F.array_join(F.slice(items, i, n), between))
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(F.size(items) >= n, runs(n)).otherwise(none) for n in range(low, high + 1)])


def with_grams(df: DataFrame, text: str, chars: tuple[int, int] = (2, 5), words: tuple[int, int] = (1, 2)) -> DataFrame:
    """df with char_grams (within words, which count a blank on either side) and word_grams; null texts have none."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    padded = F.transform(F.filter(F.split(low, r"\s+"), lambda w: w != ""), lambda w: F.split(F.concat(F.lit(" "), w, F.lit(" ")), ""))
    inside = F.flatten(F.transform(padded, lambda w: grams(w, *chars)))
    tokens = F.regexp_extract_all(low, F.lit(TOKENS), F.lit(0))
    return df.withColumns({"char_grams": inside, "word_grams": grams(tokens, *words, " ")})


def term_weights(rows: DataFrame, key: str, terms: str, least: int = 2) -> DataFrame:
    """key, term, weight of every term that at least ``least`` rows hold: (1 + ln count) x (ln((1 + rows) / (1 + rows with it)) + 1), unit length a row.

    The vocabulary is a table like any other: it is never gathered, and a row without terms has none.
    """
    counts = rows.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("c"))
    total = rows.agg(F.count("*").alias("rows"))
    idf = counts.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= least).crossJoin(F.broadcast(total))  # one row
    weighed = counts.join(idf, "term").select(key, "term", ((1 + F.log("c")) * (F.log((1 + F.col("rows")) / (1 + F.col("df"))) + 1)).alias("w"))
    norms = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def features(rows: DataFrame, vocabulary: dict[str, int], least: int = 2) -> PipelineModel:
    """Stages from the gram columns to `features`: counts, inverse frequencies, unit length, side by side."""
    stages = []
    for name, size in vocabulary.items():
        stages += [CountVectorizer(inputCol=name, outputCol=f"{name}_n", minDF=least, vocabSize=size), IDF(inputCol=f"{name}_n", outputCol=f"{name}_i"), Normalizer(inputCol=f"{name}_i", outputCol=f"{name}_x")]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=[f"{n}_x" for n in vocabulary], outputCol="features")]).fit(rows)


def folds(df: DataFrame, group: str, label: str, wanted: int = 5) -> tuple[DataFrame, int]:
    """df with fold by a hash of its group, and the number of folds: fewer, down to two, until every fold holds both classes."""
    for n in range(wanted, 1, -1):
        rows = df.withColumn("fold", (F.conv(F.substring(F.sha2(F.coalesce(F.col(group).cast("string"), F.lit("")), 256), 1, 8), 16, 10).cast("long") % n).cast("int"))
        sides = rows.groupBy("fold").agg(F.countDistinct(label).alias("c")).agg(F.count("*").alias("n"), F.min("c").alias("c")).first()
        if sides.n == n and sides.c > 1:
            return rows, n
    raise ValueError("too few groups of both classes for two folds")


def weighted(df: DataFrame, label: str) -> DataFrame:
    """df with weight: rows / (classes x rows of the class)."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"))
    share = n.crossJoin(F.broadcast(total)).select(label, (F.col("rows") / (F.col("classes") * F.col("n"))).alias("weight"))
    return df.join(F.broadcast(share), label)  # a row a class


class CalibratedSVM:
    """A linear SVM whose margin a logistic curve, fitted on margins of rows left out, turns into a probability."""

    def __init__(self, label: str, group: str, wanted: int = 5, rounds: int = 50):
        self.label, self.group, self.wanted, self.rounds = label, group, wanted, rounds

    def _svm(self, rows: DataFrame):
        return LinearSVC(featuresCol="features", labelCol=self.label, weightCol="weight", maxIter=self.rounds, regParam=1e-3).fit(weighted(rows, self.label))

    @staticmethod
    def _margin(rows: DataFrame) -> DataFrame:
        return rows.withColumn("margin", array_to_vector(F.array(vector_to_array("rawPrediction")[1]))).drop("rawPrediction", "prediction")

    def fit(self, df: DataFrame) -> CalibratedSVM:
        rows, n = folds(df.withColumn(self.label, F.col(self.label).cast("double")), self.group, self.label, self.wanted)
        left_out = [self._margin(self._svm(rows.filter(F.col("fold") != k)).transform(rows.filter(F.col("fold") == k))) for k in range(n)]
        margins = reduce(DataFrame.unionByName, [m.select("margin", self.label) for m in left_out])
        self.curve = LogisticRegression(featuresCol="margin", labelCol=self.label).fit(margins)
        self.svm = self._svm(rows)
        return self

    def transform(self, df: DataFrame, name: str = "p") -> DataFrame:
        scored = self.curve.transform(self._margin(self.svm.transform(df)))
        return scored.withColumn(name, vector_to_array("probability")[1]).drop("margin", "rawPrediction", "probability", "prediction")

    def strongest(self, vocabulary: list[str], k: int) -> list[tuple[str, float]]:
        """The k terms of largest weight; the model is on the driver as it is."""
        return sorted(zip(vocabulary, self.svm.coefficients.toArray()), key=lambda t: (-t[1], t[0]))[:k]


def one_vs_rest(df: DataFrame, labels: list[str], group: str) -> dict[str, CalibratedSVM]:
    """A calibrated model for each column of labels."""
    return {name: CalibratedSVM(name, group).fit(df) for name in labels}


def forest(df: DataFrame, label: str, trees: int = 400) -> RandomForestClassificationModel:
    return RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, seed=7).fit(df)


def in_order(probabilities: Column, classes: list[str], wanted: list[str]) -> Column:
    """Probabilities of an array in the order of classes, put in the wanted order; a missing class is an error."""
    if sorted(classes) != sorted(wanted):
        raise ValueError("the model's classes differ from the wanted ones")
    return F.array(*[probabilities[classes.index(c)] for c in wanted])


def representation(kind: str, raw: str, structured: str) -> Column:
    if kind not in ("raw", "structured"):
        raise ValueError(f"no such representation: {kind}")
    return F.col(raw if kind == "raw" else structured)
