"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Let Arrow hand Python at most so many rows at once: whole texts are large rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local session that names none uses one beside its warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and sc.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the cluster's shared checkpoint folder and read on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, rows: int, per_task: int = 50_000) -> DataFrame:
    """The same rows in about as many tasks as their counted number needs, if a shuffle left more."""
    return df.coalesce(max(8, rows // per_task))


def chunks(texts: list, chars: int = 1 << 20):
    """(first, past-last) index ranges of about so many characters each."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 1
        if size >= chars:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table does not have, whatever the letters' case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found
