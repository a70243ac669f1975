"""Baseline of sightings: statistics by scope, surprise with back-off, poison-resistant promotion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_SIGHTINGS, LEAST_DAYS, MOST_PROBABILITY = 5, 3, 0.15
#: Bits of a key that no scope knows, and what a new parent adds to the novelty.
UNKNOWN, LINEAGE = 15.0, 2.5
SENSITIVE = ("persistence", "credential", "defense", "recovery", "shadow", "download", "execute", "service", "scheduled", "registry", "autorun", "remote", "bcd", "bitsadmin", "rundll", "schtasks", "wmic", "certutil")


def scoped(df: DataFrame) -> DataFrame:
    """A row per scope level: host, role (or user) and fleet."""
    levels = F.array(
        F.struct(F.lit("host").alias("level"), F.concat(F.lit("host:"), "host_id").alias("scope_id")),
        F.struct(F.lit("role").alias("level"), F.concat(F.lit("role:"), F.coalesce("role", F.concat(F.lit("user:"), "user_name"))).alias("scope_id")),
        F.struct(F.lit("fleet").alias("level"), F.lit("fleet:default").alias("scope_id")),
    )
    return df.withColumn("x", F.explode(levels)).select("*", "x.*").drop("x")


def sightings(df: DataFrame, signature: str = "signature") -> DataFrame:
    """Per scope and signature: count, first and last seen, days, hosts, parents."""
    return scoped(df).groupBy("level", "scope_id", signature).agg(
        F.count("*").alias("seen_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.countDistinct(F.to_date("ts")).alias("distinct_days"), F.countDistinct("host_id").alias("hosts_observed"),
        F.countDistinct("parent_process").alias("parents"),
    )


def totals(df: DataFrame) -> DataFrame:
    return scoped(df).groupBy("level", "scope_id").agg(F.count("*").alias("total"))


def surprise(count, total):
    """Bits of surprise of a count with smoothing."""
    return -F.log2((count + 0.5) / (total + 50.0))


def sensitive_effect(*texts: Column) -> Column:
    """Whether a scan's reason, features, label, family or stage names a sensitive effect."""
    return F.lower(F.concat_ws(" ", *texts)).rlike("|".join(SENSITIVE))


def evaluated(df: DataFrame, signature: str = "signature", sensitive: Column | None = None) -> DataFrame:
    """What the host's baseline knew before each row: count, days, novelty of the parent, surprise, promotion.

    Promotion needs enough sightings on enough days with no flagged (probable or sensitive) sighting up to then.
    Rows are ordered within a day alone; whole days are counted first and added up, so that no host and no signature is
    ever sorted in one task.
    """
    probable = F.coalesce(F.col("probability") >= MOST_PROBABILITY, F.lit(False))
    flag = probable | F.coalesce(F.lit(False) if sensitive is None else sensitive, F.lit(False))
    rows = df.withColumns({"flag": flag.cast("long"), "__day": F.to_date("ts")})
    within = lambda *by: Window.partitionBy("host_id", *by, "__day").orderBy("ts", "event_id")
    rows = rows.withColumns({
        "__n": F.row_number().over(within(signature)) - 1, "__flags": F.sum("flag").over(within(signature)),
        "__parent": F.row_number().over(within(signature, "parent_process")), "__host": F.row_number().over(within()) - 1,
    })
    days = rows.groupBy("host_id", F.col(signature).alias("__s"), "__day").agg(F.count("*").alias("n"), F.sum("flag").alias("f"))
    earlier = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy("host_id", *by).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hosts = days.groupBy("host_id", "__day").agg(F.sum("n").alias("n")).select(F.col("host_id").alias("__h2"), F.col("__day").alias("__d2"), earlier("n").alias("__host_days"))
    nth = F.row_number().over(Window.partitionBy("host_id", "__s").orderBy("__day"))
    days = days.select(F.col("host_id").alias("__h1"), "__s", F.col("__day").alias("__d1"), earlier("n", "__s").alias("__n_days"), earlier("f", "__s").alias("__f_days"), nth.alias("__nth"))
    first = rows.groupBy(F.col("host_id").alias("__h3"), F.col(signature).alias("__s3"), F.col("parent_process").alias("__p3")).agg(F.min("__day").alias("__first"))
    same = lambda *pairs: reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in pairs])
    rows = rows.join(days, same(("host_id", "__h1"), (signature, "__s"), ("__day", "__d1"))).join(hosts, same(("host_id", "__h2"), ("__day", "__d2")))
    rows = rows.join(first, same(("host_id", "__h3"), (signature, "__s3"), ("parent_process", "__p3")))
    seen, flags = F.col("__n_days") + F.col("__n"), F.col("__f_days") + F.col("__flags")
    stable = lambda n, d, f: (n >= LEAST_SIGHTINGS) & (d >= LEAST_DAYS) & (f == 0)
    new = (F.col("__n") == 0).cast("long")
    rows = rows.withColumns({
        "new_day": new, "seen_before": seen, "days_upto": F.col("__nth").cast("long"), "flags_upto": flags, "host_before": F.col("__host_days") + F.col("__host"),
        "lineage_novel": (F.col("__day") == F.col("__first")) & (F.col("__parent") == 1),
        "promoted_upto": stable(seen + 1, F.col("__nth"), flags),
        "surprise_full": F.when(seen > 0, F.round(surprise(seen, F.col("__host_days") + F.col("__host")), 3)),
        "__before": stable(seen, F.col("__nth") - new, flags - F.col("flag")),
    })
    rows = rows.withColumn("known_stable", F.col("__before") & ~F.col("lineage_novel"))
    return rows.drop("__day", "__n", "__flags", "__parent", "__host", "__h1", "__s", "__d1", "__n_days", "__f_days", "__nth", "__h2", "__d2", "__host_days", "__h3", "__s3", "__p3", "__first", "__before")


def backed_off(rows: DataFrame, history: DataFrame, keys: list[Column], name: str, signature: str = "signature") -> DataFrame:
    """event_id, name: the surprise of the first of keys that host, else role, else fleet knows; UNKNOWN if none does."""
    counts = scoped(history).groupBy("level", "scope_id", F.col(signature).alias("key")).agg(F.count("*").alias("n")).join(totals(history), ["level", "scope_id"])
    tried = scoped(rows.withColumn("__keys", F.array(*keys))).select("event_id", "level", "scope_id", F.posexplode("__keys").alias("at", "key"))
    scope = F.when(F.col("level") == "host", 0).when(F.col("level") == "role", 1).otherwise(2)
    found = tried.join(counts, ["level", "scope_id", "key"], "left")
    bits = F.min_by(F.when(F.col("n") > 0, surprise(F.col("n"), F.col("total"))), F.when(F.col("n") > 0, scope * len(keys) + F.col("at")))
    return found.groupBy("event_id").agg(F.coalesce(bits, F.lit(UNKNOWN)).alias(name))


def _learning(history: DataFrame, signature: str, sensitive: Column | None) -> DataFrame:
    """Every sighting for every scope that learns from it: role and fleet only if the host neither promoted nor ever flagged it."""
    return scoped(evaluated(history, signature, sensitive)).filter("level = 'host' or (flags_upto = 0 and not promoted_upto)")


def learnt(history: DataFrame, signature: str = "signature", sensitive: Column | None = None) -> DataFrame:
    """level, scope_id, __key (the signature), seen_count, first_seen, promoted and flagged."""
    return _learning(history, signature, sensitive).groupBy("level", "scope_id", F.col(signature).alias("__key")).agg(
        F.count("*").alias("seen_count"), F.min("ts").alias("first_seen"), F.max("promoted_upto").alias("promoted"), F.max("flag").alias("flagged"),
    )


def novelty(rows: DataFrame, history: DataFrame, full: list[Column], exe: list[Column], signature: str = "signature", sensitive: Column | None = None) -> DataFrame:
    """Each row's status, scope, seen_count, first_seen, lineage_novel, surprises and novelty_score by a history.

    full and exe are the keys to try, from the whole signature to the executable.  Role and fleet
    learn from a sighting only if the host neither promoted nor ever flagged it.  event_id is unique in rows.
    A column in_maintenance_window of rows, if there, silences the scores.
    """
    stats = learnt(history, signature, sensitive)
    parents = _learning(history, signature, sensitive).groupBy("level", "scope_id", F.col(signature).alias("__key"), "parent_process").agg(F.lit(True).alias("parent_known"))
    rank = F.when(F.col("level") == "host", 0).when(F.col("level") == "role", 1).otherwise(2)
    seen = scoped(rows.withColumn("__key", F.col(signature))).join(stats, ["level", "scope_id", "__key"]).join(parents, ["level", "scope_id", "__key", "parent_process"], "left")
    best = seen.groupBy("event_id").agg(F.min_by(F.struct("level", "seen_count", "first_seen", "promoted", "flagged", "parent_known"), rank).alias("b"))
    out = rows.join(best, "event_id", "left").join(backed_off(rows, history, full, "sf", signature), "event_id").join(backed_off(rows, history, exe, "se", signature), "event_id")
    quiet = F.coalesce(F.col("in_maintenance_window"), F.lit(False)) if "in_maintenance_window" in rows.columns else F.lit(False)
    new = ~F.coalesce(F.col("b.parent_known"), F.lit(False))
    stable = F.coalesce((F.col("b.level") == "host") & F.col("b.promoted") & (F.col("b.flagged") == 0), F.lit(False)) & ~new
    score = 0.7 * F.col("sf") + 0.3 * F.col("se") + F.when(new, LINEAGE).otherwise(0.0)
    loud = lambda c, rest=0.0: F.when(quiet, F.lit(rest)).otherwise(c)
    return out.select(
        "event_id", F.when(quiet, "learning").when(stable, "known_stable").otherwise("rare_or_novel").alias("status"),
        loud(F.coalesce("b.level", F.lit("fleet")), "maintenance_window").alias("scope"), loud(F.coalesce("b.seen_count", F.lit(0)), 0).alias("seen_count"),
        F.when(~quiet, F.col("b.first_seen")).alias("first_seen"), loud(new, False).alias("lineage_novel"),
        loud(F.round("sf", 3)).alias("surprise_full"), loud(F.round("se", 3)).alias("surprise_exe"), loud(F.round(score, 3)).alias("novelty_score"),
    )


def allowed_to_bypass(level: Column, promoted: Column, role: Column, hosts: Column, *obstacles: Column) -> Column:
    """Whether a known signature may skip the scan: on its host, or in a named role seen on two hosts; never by fleet, nor past an obstacle (decoded, cut off, indicators, routing features)."""
    free = F.when(level == "host", promoted).when(level == "role", promoted & F.coalesce(role != "", F.lit(False)) & (hosts >= 2)).otherwise(F.lit(False))
    for o in obstacles:
        free = free & ~F.coalesce(o, F.lit(False))
    return F.coalesce(free, F.lit(False))


def decisions(bypass: Column, mode: str) -> tuple[Column, Column]:
    """(status, whether to scan) in the mode learn, audit or enforce; auditing scans what it knows, too."""
    if mode not in ("learn", "audit", "enforce"):
        raise ValueError(f"no such mode: {mode}")
    status = F.when(bypass, "known_stable").otherwise("learning" if mode == "learn" else "rare_or_novel")
    return status, F.lit(True) if mode == "audit" else ~bypass


def revoked(stats: DataFrame, revocations: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics without the promotion of the listed keys; a list of any size joins by key."""
    gone = revocations.select(*keys).distinct().withColumn("gone", F.lit(True))
    return stats.join(gone, keys, "left").withColumn("promoted", F.col("promoted") & F.col("gone").isNull()).drop("gone")
