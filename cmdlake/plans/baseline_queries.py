"""Queries of the baseline of habits: rows of the last days judged by the days before, by signature, over host, role and fleet."""

from __future__ import annotations

from pyspark.sql import functions as F

from cmdlake.operators import baseline, triage
from cmdlake.operators.graph import checkpointed
from cmdlake.plans.curation_queries import SIGNATURE
from cmdlake.sources.gallery import GALLERY_SQL, HABITS_SQL, gallery

QUERIES, ORACLE = {}, {}
CUT = "2024-01-22"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


SIGHTED = (
    SIGNATURE.replace(GALLERY_SQL, HABITS_SQL)
    + ", zs AS (SELECT event_id, ts, host_id, role, parent_process, (value % 100) / 620.0 AS probability, sg.exe, exe || '|' || verb || '|' || flags || '|' || slots AS signature, exe || ':' || verb AS k1, exe || ':' || verb || ':' || flags AS k2, exe || ':' || verb || ':' AS k0, event_id % 50 = 0 AS quiet FROM g JOIN sg USING (event_id)), "
    f"zh AS (SELECT * FROM zs WHERE ts < TIMESTAMP '{CUT}'), zq AS (SELECT * FROM zs WHERE ts >= TIMESTAMP '{CUT}')"
)
_LEVELS = "(SELECT 'host' AS level, 0 AS rank, 'host:' || host_id AS scope_id, * FROM {0} UNION ALL SELECT 'role', 1, 'role:' || role, * FROM {0} UNION ALL SELECT 'fleet', 2, 'fleet:default', * FROM {0})"
_EVALUATED = (
    ", zd AS (SELECT *, CAST(probability >= 0.15 AS BIGINT) AS flag, CAST(row_number() OVER (PARTITION BY host_id, signature, CAST(ts AS DATE) ORDER BY ts, event_id) = 1 AS BIGINT) AS new_day FROM zh), "
    "zv AS (SELECT *, sum(flag) OVER u AS flags_upto, count(*) OVER u >= 5 AND sum(new_day) OVER u >= 3 AND sum(flag) OVER u = 0 AS promoted FROM zd WINDOW u AS (PARTITION BY host_id, signature ORDER BY ts, event_id)), "
    f"lr AS (SELECT * FROM {_LEVELS.format('zv')} WHERE level = 'host' OR (flags_upto = 0 AND NOT promoted)), "
    "st AS (SELECT level, scope_id, signature, count(*) AS seen_count, min(ts) AS first_seen, bool_or(promoted) AS promoted, max(flag) AS flagged FROM lr GROUP BY 1, 2, 3), pa AS (SELECT DISTINCT level, scope_id, signature, parent_process FROM lr), "
    f"be AS (SELECT * FROM (SELECT x.event_id, x.level, st.seen_count, st.first_seen, st.promoted, st.flagged, pa.parent_process IS NOT NULL AS known, row_number() OVER (PARTITION BY x.event_id ORDER BY x.rank) AS n FROM {_LEVELS.format('zq')} x "
    "JOIN st USING (level, scope_id, signature) LEFT JOIN pa ON pa.level = x.level AND pa.scope_id = x.scope_id AND pa.signature = x.signature AND pa.parent_process = x.parent_process) WHERE n = 1)"
)
_BACKED_OFF = (
    f", hl AS (SELECT level, scope_id, signature FROM {_LEVELS.format('zh')}), tt AS (SELECT level, scope_id, count(*) AS total FROM hl GROUP BY 1, 2), kk AS (SELECT level, scope_id, signature AS key, count(*) AS n FROM hl GROUP BY 1, 2, 3), "
    f"ql AS (SELECT * FROM {_LEVELS.format('zq')}), tr AS (SELECT event_id, level, scope_id, rank, unnest([0, 1, 2, 3]) AS i, unnest([signature, k2, k1, exe]) AS kf, unnest([exe, k0, k1, exe]) AS ke FROM ql), "
    "bo AS (SELECT tr.event_id, coalesce(min_by(-log2((a.n + 0.5) / (t.total + 50.0)), tr.rank * 4 + i) FILTER (a.n IS NOT NULL), 15.0) AS sf, coalesce(min_by(-log2((b.n + 0.5) / (t.total + 50.0)), tr.rank * 4 + i) FILTER (b.n IS NOT NULL), 15.0) AS se "
    "FROM tr LEFT JOIN tt t ON t.level = tr.level AND t.scope_id = tr.scope_id LEFT JOIN kk a ON a.level = tr.level AND a.scope_id = tr.scope_id AND a.key = kf LEFT JOIN kk b ON b.level = tr.level AND b.scope_id = tr.scope_id AND b.key = ke GROUP BY 1)"
)


def sighted(spark, sf_dir):
    """Every command with its signature, the keys to back off to, a probability and whether its window is quiet."""
    rows = triage.parse_commands(gallery(spark, sf_dir, HABITS_SQL), quotes=False).withColumn("s", triage.signature())
    verb = F.concat(F.col("s.executable"), F.lit(":"), F.coalesce("s.verb", F.lit("*")))
    return rows.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "host_id", "role", F.lit(None).cast("string").alias("user_name"), "parent_process", (F.col("value") % 100 / 620.0).alias("probability"), F.col("s.raw_signature").alias("signature"),
        F.col("s.executable").alias("exe"), verb.alias("k1"), F.concat(verb, F.lit(":"), F.array_join("s.flag_set", ",")).alias("k2"), F.concat(verb, F.lit(":")).alias("k0"), (F.col("event_id") % 50 == 0).alias("in_maintenance_window"),
    )


FULL, EXE = ["signature", "k2", "k1", "exe"], ["exe", "k0", "k1", "exe"]


def halves(spark, sf_dir):
    s = checkpointed(sighted(spark, sf_dir))  # parsed once, read for every scope
    return s.filter(F.col("ts") >= CUT), s.filter(F.col("ts") < CUT)


@query(SIGHTED + _BACKED_OFF + " SELECT event_id, round(sf, 6) AS surprise_full, round(se, 6) AS surprise_exe FROM bo")
def bas5_backed_off(spark, sf_dir):
    rows, history = halves(spark, sf_dir)
    full, exe = (baseline.backed_off(rows, history, [F.col(k) for k in keys], name) for keys, name in ((FULL, "sf"), (EXE, "se")))
    return full.join(exe, "event_id").select("event_id", F.round("sf", 6).alias("surprise_full"), F.round("se", 6).alias("surprise_exe"))


@query(
    SIGHTED + _EVALUATED + _BACKED_OFF
    + ", o AS (SELECT zq.event_id, quiet, level, seen_count, first_seen, coalesce(promoted AND flagged = 0 AND level = 'host' AND known, false) AS stable, NOT coalesce(known, false) AS new, sf, se FROM zq LEFT JOIN be USING (event_id) JOIN bo USING (event_id)) "
    "SELECT event_id, CASE WHEN quiet THEN 'learning' WHEN stable THEN 'known_stable' ELSE 'rare_or_novel' END AS status, CASE WHEN quiet THEN 'maintenance_window' ELSE coalesce(level, 'fleet') END AS scope, CASE WHEN quiet THEN 0 ELSE coalesce(seen_count, 0) END AS seen_count, "
    "CASE WHEN NOT quiet THEN first_seen END AS first_seen, NOT quiet AND new AS lineage_novel, CASE WHEN quiet THEN 0.0 ELSE round(sf, 3) END AS surprise_full, CASE WHEN quiet THEN 0.0 ELSE round(se, 3) END AS surprise_exe, "
    "CASE WHEN quiet THEN 0.0 ELSE round(0.7 * sf + 0.3 * se + CASE WHEN new THEN 2.5 ELSE 0.0 END, 3) END AS novelty_score FROM o"
)
def bas6_bas7_novelty(spark, sf_dir):
    rows, history = halves(spark, sf_dir)
    return baseline.novelty(rows, history, [F.col(k) for k in FULL], [F.col(k) for k in EXE])


@query(
    SIGHTED + _EVALUATED + " SELECT level, scope_id, count(*) AS n_signatures, CAST(sum(seen_count) AS BIGINT) AS sightings, CAST(sum(CAST(promoted AND flagged = 0 AS BIGINT)) AS BIGINT) AS promoted, CAST(sum(flagged) AS BIGINT) AS flagged FROM st GROUP BY 1, 2"
)
def bas3_bas7_scopes(spark, sf_dir):
    """What each scope has learnt: role and fleet only what its hosts neither promoted nor flagged."""
    stats = baseline.learnt(halves(spark, sf_dir)[1])
    good = (F.col("promoted") & (F.col("flagged") == 0)).cast("long")
    return stats.groupBy("level", "scope_id").agg(F.count("*").alias("n_signatures"), F.sum("seen_count").alias("sightings"), F.sum(good).alias("promoted"), F.sum("flagged").alias("flagged"))
