"""Writers of datasets, their manifest, and its audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_rows(df: DataFrame, path: str, kind: str = "parquet", by: str | None = None) -> None:
    """A folder of files, never over an existing one; CSV files have headers, JSON is a row a line."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"no such kind of file: {kind}")
    out = df.write.mode("errorifexists")
    out = out.partitionBy(by) if by else out
    (out.option("header", True).option("escape", '"') if kind == "csv" else out).format(kind).save(path)


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, bytes, sha256 of each file below a folder; a file passes through one task, as its digest needs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def audit(spark: SparkSession, path: str, stored: DataFrame, rows: DataFrame, key: str, split: str, splits: list[str]) -> DataFrame:
    """problem, subject: files that differ from the stored manifest, empty splits, and keys in two splits (counted by pair)."""
    now = manifest(spark, path).select("name", F.col("sha256").alias("now"))
    files = stored.join(now, "name", "full").filter(~F.col("sha256").eqNullSafe(F.col("now"))).select(F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unknown").otherwise("changed").alias("problem"), F.col("name").alias("subject"))
    wanted = spark.createDataFrame([(s,) for s in splits], f"`{split}` string")
    empty = wanted.join(rows.select(split).distinct(), split, "left_anti").select(F.lit("empty split").alias("problem"), F.col(split).alias("subject"))
    sides = rows.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).filter(F.size("s") > 1)
    shared = sides.groupBy("s").agg(F.count("*").alias("n")).select(F.lit("shared keys").alias("problem"), F.concat(F.array_join("s", "/"), F.lit(": "), F.col("n").cast("string")).alias("subject"))
    return reduce(DataFrame.unionByName, (files, empty, shared))


def predictions(df: DataFrame, key: str, scores: str, targets: str, names: list[str], threshold: float) -> DataFrame:
    """key, scores by name, targets and the labels at or above the threshold, ready to be written as JSON."""
    label = F.array(*map(F.lit, names))
    chosen = F.filter(F.transform(scores, lambda p, i: F.when(p >= threshold, F.element_at(label, i + 1))), lambda x: x.isNotNull())
    return df.select(key, F.map_from_arrays(label, scores).alias("scores"), F.col(targets).alias("targets"), chosen.alias("selected"))
