"""The baseline of habits as keyed state over host, role and fleet.

Three stateful streams: ``host_sightings`` keeps what a host knows of a signature, and says of each sighting whether role and
fleet may learn from it.  Its log feeds ``scope_knowledge``, which keeps the counts of every scope's keys, and
``parent_knowledge``, which keeps which parents a scope has seen run a signature.  Totals by scope are a plain aggregate.
``judged`` joins what they said of an event into the status, scope and novelty that operators.baseline.novelty gives.

Every state is a few numbers (and up to LEAST_DAYS days) of one host and signature, one scope and key, or one scope, signature
and parent: none grows with the rows, and with ``ttl_days`` each goes when it was not used for so long (such a query never
ends by itself).  Rows of one key that arrive together
are taken in order of time; not even the fleet is one key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cmdlake.operators.baseline import LEAST_DAYS, LEAST_SIGHTINGS, LINEAGE, MOST_PROBABILITY, UNKNOWN, scoped, surprise

CARRIED = "event_id long, ts timestamp, host_id string, role string, user_name string, parent_process string, signature string, full_keys array<string>, exe_keys array<string>, asks boolean, learns boolean, quiet boolean"
HOST = CARRIED + ", seen_count long, first_seen timestamp, promoted boolean, shared boolean"
SCOPE = "event_id long, level string, scope_id string, key string, n long, learnt long, first_seen timestamp"
PARENT = "event_id long, level string, known boolean"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state in RocksDB, beside the heap and on disk, for sessions that judge many hosts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _keyed(step: Callable, first: tuple, schema: str, ttl_days: int | None):
    """A state function: step(key, state tuple, row) gives the next state and an output row or None, row by row in order of time."""
    columns = _names(schema)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, out = tuple(state.get) if state.exists else first, []
        for r in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples(index=False):
            now, said = step(key, now, r)
            if said is not None:
                out.append(said)
        state.update(now)
        if ttl_days is not None:
            state.setTimeoutDuration(ttl_days * 24 * 3600 * 1000)
        made = pd.DataFrame(out, columns=columns)
        for c in ("ts", "first_seen"):
            if c in made:
                made[c] = pd.to_datetime(made[c])
        yield made

    return run


def _timeout(ttl_days: int | None) -> str:
    return GroupStateTimeout.NoTimeout if ttl_days is None else GroupStateTimeout.ProcessingTimeTimeout


def _micros(x: pd.Timestamp) -> int:
    return int(x.value // 1000)


def _when(x: int) -> pd.Timestamp | None:
    return pd.Timestamp(x, unit="us") if x >= 0 else None


def _sight(key: tuple, state: tuple, r) -> tuple:
    seen, flags, first, promoted, days = state
    was, shared = (seen, _when(first), bool(promoted and flags == 0)), False
    if r.learns:
        seen, flags = seen + 1, flags + int(bool(r.flag))
        first = _micros(r.ts) if first < 0 else min(first, _micros(r.ts))
        day = r.ts.strftime("%Y-%m-%d")
        if day not in days and len(days) < LEAST_DAYS:
            days = [*days, day]
        now = seen >= LEAST_SIGHTINGS and len(days) >= LEAST_DAYS and flags == 0
        promoted, shared = bool(promoted or now), flags == 0 and not now
    return (int(seen), int(flags), int(first), promoted, list(days)), (*(getattr(r, c) for c in _names(CARRIED)), *was, shared)


def host_sightings(stream: DataFrame, sensitive: Column | None = None, ttl_days: int | None = None) -> DataFrame:
    """Rows of CARRIED's columns and probability, with what their host knew before them and whether role and fleet learn from them.

    ``asks`` rows are judged, ``learns`` rows remembered; a row may be both, and is then judged first.
    """
    flag = F.coalesce(F.col("probability") >= MOST_PROBABILITY, F.lit(False)) | F.coalesce(F.lit(False) if sensitive is None else sensitive, F.lit(False))
    rows = stream.select(*_names(CARRIED), flag.alias("flag"))
    run = _keyed(_sight, (0, 0, -1, False, []), HOST, ttl_days)
    return rows.groupBy("host_id", "signature").applyInPandasWithState(run, HOST, "seen long, flags long, first long, promoted boolean, days array<string>", "append", _timeout(ttl_days))


def _count(key: tuple, state: tuple, r) -> tuple:
    n, learnt, first = state
    said = (r.event_id, *key, n, learnt, _when(first)) if r.asks else None
    if r.learns:
        n += 1
        if r.shared:
            learnt, first = learnt + 1, _micros(r.ts) if first < 0 else min(first, _micros(r.ts))
    return (int(n), int(learnt), int(first)), said


def scope_knowledge(sightings: DataFrame, ttl_days: int | None = None) -> DataFrame:
    """Of every asking row, scope and key to try: how often the scope met the key, and how often and since when it learnt it."""
    keys = F.array_distinct(F.concat(F.array(F.struct(F.col("signature").alias("key"), F.col("learns").alias("learns"))), F.when(F.col("asks"), F.transform(F.concat("full_keys", "exe_keys"), lambda k: F.struct(k.alias("key"), (F.col("learns") & (k == F.col("signature"))).alias("learns")))).otherwise(F.array())))
    rows = scoped(sightings).select("event_id", "ts", "level", "scope_id", "asks", "shared", F.explode(keys).alias("k")).select("*", "k.*").drop("k")
    run = _keyed(_count, (0, 0, -1), SCOPE, ttl_days)
    return rows.groupBy("level", "scope_id", "key").applyInPandasWithState(run, SCOPE, "n long, learnt long, first long", "append", _timeout(ttl_days))


def _meet(key: tuple, state: tuple, r) -> tuple:
    return (bool(state[0] or r.counts),), ((r.event_id, key[0], bool(state[0])) if r.asks else None)


def parent_knowledge(sightings: DataFrame, ttl_days: int | None = None) -> DataFrame:
    """Of every asking row and scope: whether the scope has learnt the signature from this parent."""
    counts = F.when(F.col("level") == "host", F.col("learns")).otherwise(F.col("shared"))
    rows = scoped(sightings).select("event_id", "ts", "level", "scope_id", "signature", "parent_process", "asks", counts.alias("counts"))
    run = _keyed(_meet, (False,), PARENT, ttl_days)
    return rows.groupBy("level", "scope_id", "signature", "parent_process").applyInPandasWithState(run, PARENT, "known boolean", "append", _timeout(ttl_days))


def scope_totals(sightings: DataFrame) -> DataFrame:
    """level, scope_id, total: a plain aggregate, batch or streaming."""
    return scoped(sightings.filter("learns")).groupBy("level", "scope_id").agg(F.count("*").alias("total"))


def judged(sightings: DataFrame, knowledge: DataFrame, parents: DataFrame, totals: DataFrame) -> DataFrame:
    """event_id, status, scope, seen_count, first_seen, lineage_novel, surprises and novelty_score of the asking rows."""
    rank = F.when(F.col("level") == "host", 0).when(F.col("level") == "role", 1).otherwise(2)
    asked = sightings.filter("asks").select("event_id", "quiet", "signature", "full_keys", "exe_keys", F.col("seen_count").alias("own_n"), F.col("first_seen").alias("own_first"), "promoted")
    rows = knowledge.join(totals, ["level", "scope_id"], "left").join(asked.select("event_id", "signature", "full_keys", "exe_keys"), "event_id")
    bits = lambda keys: F.coalesce(F.min_by(F.when(F.col("n") > 0, surprise(F.col("n"), F.col("total"))), F.when((F.col("n") > 0) & F.array_contains(keys, F.col("key")), rank * 16 + F.array_position(F.col(keys), F.col("key")))), F.lit(UNKNOWN))
    wide = F.when((F.col("level") != "host") & (F.col("key") == F.col("signature")) & (F.col("learnt") > 0), rank)
    about = rows.groupBy("event_id").agg(F.min_by(F.struct("level", "learnt", "first_seen"), wide).alias("b"), bits("full_keys").alias("sf"), bits("exe_keys").alias("se"))
    met = parents.groupBy("event_id").agg(*[F.max(F.when(F.col("level") == x, F.col("known"))).alias(f"known_{x}") for x in ("host", "role", "fleet")])
    out = asked.join(about, "event_id").join(met, "event_id")
    level = F.when(F.col("own_n") > 0, "host").otherwise(F.coalesce("b.level", F.lit("none")))
    known = F.when(level == "host", F.col("known_host")).when(level == "role", F.col("known_role")).when(level == "fleet", F.col("known_fleet"))
    new, quiet, own = ~F.coalesce(known, F.lit(False)), F.coalesce("quiet", F.lit(False)), F.col("own_n") > 0
    loud = lambda c, rest=0.0: F.when(quiet, F.lit(rest)).otherwise(c)
    score = 0.7 * F.col("sf") + 0.3 * F.col("se") + F.when(new, LINEAGE).otherwise(0.0)
    return out.select(
        "event_id", F.when(quiet, "learning").when(own & F.col("promoted") & ~new, "known_stable").otherwise("rare_or_novel").alias("status"),
        loud(F.when(level == "none", "fleet").otherwise(level), "maintenance_window").alias("scope"), loud(F.when(own, F.col("own_n")).otherwise(F.coalesce("b.learnt", F.lit(0))), 0).alias("seen_count"),
        F.when(~quiet, F.when(own, F.col("own_first")).otherwise(F.col("b.first_seen"))).alias("first_seen"), loud(new, False).alias("lineage_novel"),
        loud(F.round("sf", 3)).alias("surprise_full"), loud(F.round("se", 3)).alias("surprise_exe"), loud(F.round(score, 3)).alias("novelty_score"),
    )
