"""A training corpus from raw documents: language, quality, near copies, repeated passages, packing.

Null and empty texts have no language and go in the first stage; very long texts stay whole. Repeated rows and near
copies leave one row, of equal smallest ids each row with a text of its own. Null ids, sources and languages are
carried through, as are further columns of any name. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdlake.llm import langid, near_dedup, packing, quality, repeats, suffix_dedup
from cmdlake.llm.common import fresh, small_batches

#: Texts whose best language has a lower calibrated probability are rejected.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter or without a clear language."""
    small_batches(docs)
    model = langid.train(docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang"))
    (x,) = fresh(docs, "x")
    found = docs.withColumn(x, langid.language_of(F.col("text"), model))
    return found.filter((F.col(x)["lang_pred"] != "und") & (F.col(x)["score"] >= LEAST_SCORE)).drop(x)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects repetitive or very short texts and those outside their script's fertility band."""
    (x,) = fresh(docs, "x")
    return docs.withColumn(x, quality.quality_of(F.col("text"))).filter(F.col(x)["kept"]).drop(x)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat elsewhere; a text may become empty."""
    left = suffix_dedup.remaining_text(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("quality_rules", rules), ("near_dedup", near_copies), ("suffix_dedup", passages), ("packing", packed)]

#: No stage but the last could be told in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = repeats.written(docs)
    return docs
