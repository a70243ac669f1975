"""Streams over files give what the batch forms give."""

from pyspark.sql import functions as F

from cmdlake.sources.commands import commands
from cmdlake.streaming import sightings

DIR = "/root/testdata/sf0.001"


def drained(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_daily_sightings(spark, tmp_path):
    batch = commands(spark, DIR).select("ts", "host_id", "command")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    got = drained(sightings.daily_sightings(stream), "daily", "complete").agg(F.count("*"), F.sum("seen_count")).first()
    want = batch.groupBy(F.to_date("ts"), "host_id", "command").count().agg(F.count("*"), F.sum("count")).first()
    assert tuple(got) == tuple(want)


def test_first_sightings_and_scan(spark, tmp_path):
    batch = commands(spark, DIR).select("ts", "host_id", "command")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    got = drained(sightings.scanned(sightings.first_sightings(stream, "60 days")), "firsts", "append")
    assert got.count() == batch.select("host_id", "command").distinct().count()


def test_stateful_baseline(spark, tmp_path):
    from cmdlake.operators.baseline import evaluated
    from cmdlake.plans.command_queries import signed
    from cmdlake.streaming.baseline import evaluated_stream

    batch = signed(spark, DIR).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "host_id", "signature", "parent_process", "probability")
    for part, rows in enumerate((batch.filter("ts < '2024-01-12'"), batch.filter("ts >= '2024-01-12'"))):
        rows.coalesce(1).write.parquet(str(tmp_path / f"in/p={part}"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    columns = ["event_id", "seen_before", "lineage_novel", "promoted_upto", "known_stable"]
    got = drained(evaluated_stream(stream), "stateful", "append").select(*columns)
    want = evaluated(batch).select(*columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
