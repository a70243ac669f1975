"""Back-off over scopes and keys, novelty and the sensitive-effect flag."""

from math import log2

from pyspark.sql import functions as F

from cmdlake.operators import baseline

SCHEMA = "event_id long, host_id string, role string, user_name string, parent_process string, ts timestamp_ntz, signature string, exe string, probability double, reason string, in_maintenance_window boolean"


def row(i, host, day, signature, parent="sh", reason="", role="r1", quiet=False):
    import datetime

    return (i, host, role, "u", parent, datetime.datetime(2026, 1, day, i % 24), signature, signature.split("|")[0], 0.01, reason, quiet)


def test_novelty(spark):
    history = [row(i, "h1", 1 + i, "ls|a") for i in range(6)] + [row(6 + i, "h1", 1 + i, "cp|x", reason="Credential access") for i in range(6)] + [row(12, "h2", 3, "df|y"), row(13, "h3", 3, "du", role="r2")]
    rows = [row(100, "h1", 20, "ls|a"), row(101, "h1", 20, "ls|a", "cron"), row(102, "h1", 20, "cp|x"), row(103, "h1", 20, "df|y"), row(104, "h1", 20, "du|z"), row(105, "h1", 20, "nothing|q"), row(106, "h1", 20, "ls|a", quiet=True)]
    h, r = spark.createDataFrame(history, SCHEMA), spark.createDataFrame(rows, SCHEMA)
    out = baseline.novelty(r, h, [F.col("signature"), F.col("exe")], [F.col("exe")], sensitive=baseline.sensitive_effect(F.col("reason")))
    got = {x.event_id: x for x in out.collect()}
    assert {k: (x.status, x.scope, x.seen_count, x.lineage_novel) for k, x in got.items()} == {
        100: ("known_stable", "host", 6, False), 101: ("rare_or_novel", "host", 6, True), 102: ("rare_or_novel", "host", 6, False), 103: ("rare_or_novel", "role", 1, False),
        104: ("rare_or_novel", "fleet", 0, True), 105: ("rare_or_novel", "fleet", 0, True), 106: ("learning", "maintenance_window", 0, False),
    }
    bits = lambda n, total: round(-log2((n + 0.5) / (total + 50)), 3)
    assert [got[k].surprise_full for k in (100, 103, 104, 105, 106)] == [bits(6, 12), bits(1, 13), bits(1, 14), 15.0, 0.0]
    assert (got[105].novelty_score, got[105].surprise_exe) == (17.5, 15.0)


def test_sensitive_sightings_are_not_promoted(spark):
    h = spark.createDataFrame([row(i, "h1", 1 + i, "cp|x", reason="sets up Persistence") for i in range(7)], SCHEMA)
    plain = baseline.evaluated(h).filter("promoted_upto").count()
    assert plain == 3 and baseline.evaluated(h, sensitive=baseline.sensitive_effect(F.col("reason"))).filter("promoted_upto").count() == 0
