"""Streaming forms: continuous structuring, daily sightings, duplicate suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdlake.operators.triage import parse_commands


def scanned(stream: DataFrame) -> DataFrame:
    """Stateless: every command with its fields; the same expressions as in batch."""
    return parse_commands(stream)


def _timed(stream: DataFrame) -> DataFrame:
    """Event time as an instant: a time without a zone is read in the session's zone (UTC here)."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_sightings(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts per host, command and day; the watermark bounds state and is an addition to the batch form."""
    days = _timed(stream).withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "host_id", "command")
    return days.agg(F.count("*").alias("seen_count"), F.max("ts").alias("last_seen")).select(F.col("window.start").alias("day"), "host_id", "command", "seen_count", "last_seen")


def first_sightings(stream: DataFrame, within: str = "1 day") -> DataFrame:
    """A host's command once within the watermark."""
    return _timed(stream).withWatermark("ts", within).dropDuplicatesWithinWatermark(["host_id", "command"])
