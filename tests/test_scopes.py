"""The stateful streams over three scopes judge as the batch form does."""

from pyspark.sql import functions as F

from cmdlake.operators import baseline
from cmdlake.operators.graph import checkpointed
from cmdlake.plans import baseline_queries as queries
from cmdlake.streaming import scopes

DIR = "/root/testdata/sf0.001"


def logged(df, path, name):
    q = df.writeStream.outputMode("append").format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.parquet(f"{path}/{name}")


def test_replay(spark, tmp_path):
    s = checkpointed(queries.sighted(spark, DIR)).withColumns({"full_keys": F.array(*queries.FULL), "exe_keys": F.array(*queries.EXE), "quiet": F.col("in_maintenance_window"), "asks": F.col("ts") >= queries.CUT}).withColumn("learns", ~F.col("asks"))
    for i, (low, high) in enumerate((("2024-01-01", "2024-01-09"), ("2024-01-09", queries.CUT), (queries.CUT, "2024-02-20"))):
        s.filter(F.col("ts").between(low, high) & (F.col("ts") < high)).coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    sightings = logged(scopes.host_sightings(stream), tmp_path, "host")
    assert sightings.count() == s.count()
    again = spark.readStream.schema(sightings.schema).parquet(str(tmp_path / "host"))
    knowledge = logged(scopes.scope_knowledge(again), tmp_path, "scope")
    parents = logged(scopes.parent_knowledge(again), tmp_path, "parent")
    got = scopes.judged(sightings, knowledge, parents, scopes.scope_totals(sightings))
    want = baseline.novelty(s.filter("asks"), s.filter("learns"), [F.col(k) for k in queries.FULL], [F.col(k) for k in queries.EXE])
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
    assert {r.status for r in got.select("status").distinct().collect()} >= {"rare_or_novel", "learning"}


def test_one_stream_that_asks_and_learns(spark, tmp_path):
    row = lambda i, day, p=0.01, parent="sh": (i, f"2026-01-{day:02d} 03:00:00", "h1", "r1", "u", parent, "ls|*||", ["ls|*||", "ls"], ["ls"], True, True, False, p)
    rows = [row(i, 1 + i) for i in range(7)] + [row(7, 8, parent="cron"), row(8, 9, 0.9), row(9, 10)]
    df = spark.createDataFrame(rows, "event_id long, ts string, " + scopes.CARRIED.split(", ", 2)[2] + ", probability double").withColumn("ts", F.to_timestamp("ts"))
    for i in range(2):
        df.filter(F.col("event_id") % 10 < 4 if i == 0 else F.col("event_id") >= 4).coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = {r.event_id: r for r in logged(scopes.host_sightings(stream), tmp_path, "host").collect()}
    assert [got[i].seen_count for i in range(10)] == list(range(10))
    assert [got[i].promoted for i in range(10)] == [False] * 5 + [True, True, True, True, False]
    assert [got[i].shared for i in range(10)] == [True] * 4 + [False] * 6
