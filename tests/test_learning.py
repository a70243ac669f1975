"""Calibrated models on the given texts: held-out accuracy, folds, order of classes."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cmdlake.operators import learning


def test_grams(spark):
    df = learning.with_grams(spark.createDataFrame([("Ab -x",), (None,), ("",)], "t string"), "t", (2, 3))
    got = df.collect()
    assert got[0].char_grams[:5] == [" a", "ab", "b ", " ab", "ab "] and got[0].word_grams == ["ab", "-x", "ab -x"] and got[1].char_grams == [] == got[2].word_grams


def test_calibrated_gate(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 200).alias("text"), F.when(F.col("lang") == "en", 1.0).otherwise(0.0).alias("y"), (F.col("doc_id") % 20).alias("g"))
    rows = learning.with_grams(docs, "text", (2, 3), (1, 1)).filter("text is not null").cache()
    train, test = rows.filter("doc_id % 3 <> 0"), rows.filter("doc_id % 3 = 0")
    model = learning.features(train, {"char_grams": 500, "word_grams": 500})
    made = model.transform(train).cache()
    svm = learning.CalibratedSVM("y", "g", wanted=2, rounds=20).fit(made)
    right = svm.transform(model.transform(test)).select(F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("int")), F.min("p"), F.max("p")).first()
    assert right[0] > 0.85 and 0 <= right[1] < 0.5 < right[2] <= 1
    assert len(svm.strongest([*model.stages[0].vocabulary, *model.stages[3].vocabulary], 5)) == 5
    ranked = learning.forest(made, "y", 10).transform(model.transform(test)).withColumn("p", learning.in_order(vector_to_array("probability"), ["other", "en"], ["en", "other"]))
    assert ranked.filter((F.col("p")[0] > 0.5) != (F.col("prediction") == 1)).count() <= ranked.count() * 0.02


def test_refusals(spark):
    one = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "g string, y double")
    with pytest.raises(ValueError):
        learning.folds(one, "g", "y")
    with pytest.raises(ValueError):
        learning.in_order(F.col("p"), ["a"], ["b"])
    with pytest.raises(ValueError):
        learning.representation("other", "a", "b")
