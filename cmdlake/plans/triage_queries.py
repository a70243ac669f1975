"""Queries over the gallery of commands: every parsed field, every feature, every rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdlake.functions import parsing, rule_table
from cmdlake.operators import triage
from cmdlake.sources.gallery import GALLERY_SQL, gallery

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# The same fields in DuckDB, written from their definitions.
def _any(names) -> str:
    return "(" + ", ".join("'" + n + "'" for n in names) + ")"


_FLAG = "({0} <> '' AND (starts_with({0}, '--') OR (starts_with({0}, '-') AND length({0}) > 1) OR (starts_with({0}, '/') AND length({0}) > 1 AND NOT contains(substr({0}, 2), '/'))))"
_OPS = "['|','>','>>','<','<<','2>','2>>','1>','1>>','&&','||',';']"
_REMOTE = "(contains({0}, '@') OR starts_with({0}, chr(92) || chr(92)))"
_PATH = (
    r"(regexp_matches({0}, '^[A-Za-z]:\\') OR regexp_matches({0}, '^\.\.?\\') OR {0} IN ('.', '..', '~') OR regexp_matches({0}, '^(/|\./|\.\./|~/)') OR "
    r"regexp_matches(lower({0}), '\.(exe|dll|hta|ps1|bat|cmd|sh|py|zip|tar|gz|tgz|7z|rar|log|txt|csv|json|yaml|yml|conf|cfg|bak|pdf)$'))"
)
_BASE = "lower(string_split({0}, '/')[-1])"
_STRIP = "trim({0}, chr(34) || chr(39))"
_NOT_FILE = r"NOT regexp_matches(d, '\.(exe|dll|bat|cmd|ps1|sh|py|zip|tar|gz|tgz|7z|rar|txt|log|json|yaml|yml|cfg|conf|pdf|bin|dat|tmp|hta|vbs|js|jar|msi|iso|img)$')"
_MARK = lambda marks: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(x, '{p}') THEN '{n}' END" for p, n in marks) + "], lambda m: m IS NOT NULL)"
_MAP = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in parsing.INTERPRETERS.items()) + " END"
_DASH = "(exe = 'tar' AND len(list_filter(toks, lambda t: starts_with(t, '-') AND contains(lower(t), '{0}'))) > 0)"
PARSED = (
    f"WITH g AS ({GALLERY_SQL}), a AS (SELECT *, regexp_replace(regexp_replace(command, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS x FROM g), "
    r"b AS (SELECT *, regexp_extract_all(x, '\x22[^\x22]*\x22|\S+') AS toks FROM a), "
    f"c AS (SELECT *, list_filter(toks, lambda t: NOT list_contains({_OPS}, t)) AS real FROM b), "
    f"d AS (SELECT *, {_BASE.format(_STRIP.format('real[1]'))} AS exe, {_STRIP.format('real[2]')} AS cand FROM c), "
    f"e AS (SELECT *, CASE WHEN cand IS NULL OR {_FLAG.format('cand')} THEN NULL WHEN exe IN {_any(triage.SUBCOMMAND_TOOLS)} OR (exe = 'vssadmin' AND cand IN {_any(triage.SHADOW_VERBS)}) THEN lower(cand) END AS sub0 FROM d), "
    f"f AS (SELECT *, list_transform(CASE WHEN sub0 IS NULL THEN real[2:] ELSE real[3:] END, lambda t: {_STRIP.format('t')}) AS rest, "
    r"list_distinct(regexp_extract_all(x, '(?i)\b(?:https?|ftp)://[^\s\x22\x27<>|]+')) AS urls, "
    r"list_distinct(list_filter(regexp_extract_all(x, '\b(?:\d{1,3}\.){3}\d{1,3}\b'), lambda i: len(list_filter(string_split(i, '.'), lambda o: CAST(o AS INTEGER) > 255 OR (o <> '0' AND starts_with(o, '0')))) = 0)) AS ips, "
    r"list_distinct(regexp_extract_all(x, '(?i)\b(?:HKLM|HKCU|HKCR|HKU|HKCC)\\[^\s\x22\x27]+')) AS regs, len(list_filter(regexp_extract_all(x, '\|+'), lambda p: p = '|')) > 0 AS has_pipe FROM e), "
    f"h AS (SELECT *, list_distinct(list_filter(rest, lambda t: {_FLAG.format('t')})) AS flags, list_distinct(list_filter(rest, lambda t: t <> '' AND NOT {_FLAG.format('t')})) AS args, "
    f"list_filter(list_transform(toks, lambda t: {_STRIP.format('t')}), lambda t: NOT list_contains({_OPS}, t) AND NOT {_FLAG.format('t')} AND NOT list_contains(urls, t)) AS operands FROM f), "
    f"i AS (SELECT *, list_distinct(list_filter(operands, lambda t: {_REMOTE.format('t')})) AS remotes, list_distinct(list_filter(operands, lambda t: NOT {_REMOTE.format('t')} AND {_PATH.format('t')})) AS paths, "
    r"list_distinct(list_filter(list_transform(list_concat(list_filter(regexp_extract_all(x, '(?i)\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}\b'), lambda d: NOT regexp_matches(d, '(^|\.)[A-Z]')), "
    r"list_transform(urls, lambda u: string_split(string_split(string_split(regexp_replace(u, '^[A-Za-z]+://', ''), '/')[1], '@')[-1], ':')[1])), lambda d: lower(d)), "
    rf"lambda d: d <> '' AND NOT regexp_matches(d, '^(?:\d{{1,3}}\.){{3}}\d{{1,3}}$') AND {_NOT_FILE})) AS domains, "
    r"list_distinct(list_filter(list_transform(regexp_extract_all(x, ':(\d{1,5})(?:\b|/)', 1), lambda p: CAST(p AS INTEGER)), lambda p: p BETWEEN 1 AND 65535)) AS ports, "
    f"list_distinct(list_filter(list_transform(list_filter(toks, lambda t: NOT {_FLAG.format('t')}), lambda t: {_MAP.format(_BASE.format('t'))}), lambda m: m IS NOT NULL)) AS interps, "
    f"{_MARK(parsing.ENCODED)} AS encs, {_MARK(parsing.OBFUSCATED)} AS obfs, len(list_filter(flags, lambda t: lower(t) IN {_any(parsing.INLINE_FLAGS)})) > 0 AS inline_code FROM h), "
    f"p AS (SELECT *, CASE WHEN len(regs) > 0 OR exe IN {_any(triage.WINDOWS_EXECUTABLES)} OR ends_with(exe, '.exe') THEN 'windows' WHEN exe IN {_any(parsing.LINUX_TOOLS)} THEN 'linux' WHEN len(list_filter(flags, lambda t: starts_with(t, '/'))) > 0 THEN 'windows' ELSE 'unknown' END AS platform, "
    f"exe IN {_any((*parsing.PROXY_WINDOWS, *parsing.PROXY_LINUX))} AS lolbin, list_filter([CASE WHEN exe IN {_any(parsing.ARCHIVERS)} THEN 'archive_tool' END, CASE WHEN {_DASH.format('x')} OR exe IN ('unzip', 'unrar', 'gunzip') THEN 'archive_extract' END, "
    f"CASE WHEN {_DASH.format('c')} OR exe IN ('zip', '7z', '7za', 'rar', 'gzip') THEN 'archive_create' END, CASE WHEN {_DASH.format('z')} THEN 'compression_gzip' END, "
    r"CASE WHEN len(list_filter(toks, lambda t: regexp_matches(lower(t), '\.(zip|tar|gz|tgz|bz2|xz|7z|rar)$'))) > 0 THEN 'archive_path' END, CASE WHEN contains(lower(x), 'backup') THEN 'backup_keyword' END], lambda m: m IS NOT NULL) AS archs FROM i)"
)
_LIST = "array_to_string(list_sort({0}), ' ')"


def parsed(spark, sf_dir) -> DataFrame:
    return triage.parse_commands(gallery(spark, sf_dir), quotes=False)


def _joined(name: str):
    return F.array_join(F.array_sort(F.col(name).cast("array<string>")), " ")


@query(
    PARSED + f" SELECT event_id, exe AS executable, sub0 AS subcommand, {_LIST.format('flags')} AS flags, {_LIST.format('args')} AS positional_args, platform, has_pipe, inline_code FROM p"
)
def par5_par6_par12_structure(spark, sf_dir):
    return parsed(spark, sf_dir).select("event_id", "executable", "subcommand", _joined("flags").alias("flags"), _joined("positional_args").alias("positional_args"), "platform", "has_pipe", "inline_code")


@query(
    PARSED + f" SELECT event_id, {_LIST.format('urls')} AS urls, {_LIST.format('ips')} AS ips, {_LIST.format('domains')} AS domains, {_LIST.format('list_transform(ports, lambda p: CAST(p AS VARCHAR))')} AS ports, {_LIST.format('regs')} AS registry_paths, "
    f"{_LIST.format('paths')} AS file_paths, {_LIST.format('list_distinct(list_concat(paths, regs))')} AS local_targets, {_LIST.format('list_distinct(list_concat(urls, remotes))')} AS remote_targets FROM p"
)
def par9_par17_targets(spark, sf_dir):
    names = ("urls", "ips", "domains", "ports", "registry_paths", "file_paths", "local_targets", "remote_targets")
    return parsed(spark, sf_dir).select("event_id", *[_joined(n).alias(n) for n in names])


@query(
    PARSED + f" SELECT event_id, {_LIST.format('interps')} AS interpreter_markers, {_LIST.format('encs')} AS encoded_markers, {_LIST.format('obfs')} AS obfuscation_markers, {_LIST.format('archs')} AS archive_indicators, "
    "CASE WHEN lolbin THEN exe ELSE '' END AS lolbin_matches FROM p"
)
def par13_par16_markers(spark, sf_dir):
    names = ("interpreter_markers", "encoded_markers", "obfuscation_markers", "archive_indicators", "lolbin_matches")
    return parsed(spark, sf_dir).select("event_id", *[_joined(n).alias(n) for n in names])


_HAS = lambda col, *values: f"len(list_filter({col}, lambda t: lower(t) IN {_any(values)})) > 0"
_SUB = lambda *values: f"coalesce(sub0 IN {_any(values)}, false)"
_FAR = "(len(remotes) > 0 OR len(urls) > 0)"
FEATURES = {
    "has_remote_target": _FAR, "has_local_target": "(len(paths) > 0 OR len(regs) > 0)", "writes_local_file": "len(paths) > 0",
    "writes_executable_like_file": r"len(list_filter(paths, lambda t: regexp_matches(lower(t), '\.(exe|dll|bat|cmd|ps1|vbs|js|hta|sh|py|jar)$'))) > 0",
    "archive_create": "list_contains(archs, 'archive_create')", "archive_extract": "list_contains(archs, 'archive_extract')",
    "compression_or_archiving": rf"(len(archs) > 0 OR exe IN {_any(parsing.ARCHIVERS)} OR len(list_filter(paths, lambda t: regexp_matches(lower(t), '\.(zip|tar|gz|tgz|7z|rar|bz2|xz)$'))) > 0)",
    "downloads_remote_resource": f"(exe IN ('curl', 'wget', 'certutil', 'bitsadmin', 'powershell', 'powershell.exe') AND {_FAR})",
    "transfers_file_to_remote": f"((exe IN ('scp', 'rsync', 'sftp') AND {_FAR}) OR (exe IN ('scp', 'ssh', 'rsync') AND (len(list_filter(remotes, lambda t: contains(t, '@'))) > 0 OR len(list_filter(urls, lambda t: contains(t, '@'))) > 0)))",
    "executes_inline_code": "inline_code", "runs_interpreter": "len(interps) > 0", "uses_encoded_payload": "len(encs) > 0", "uses_obfuscation": "len(obfs) > 0",
    "creates_scheduled_task": f"(exe IN ('schtasks', 'schtasks.exe', 'at', 'cron', 'crontab', 'launchctl', 'systemd-run') AND ({_HAS('flags', '/create')} OR {_HAS('args', 'create')}))",
    "modifies_registry_autorun": r"(exe IN ('reg', 'reg.exe') AND " + _SUB("add", "delete", "import") + r" AND len(list_filter(regs, lambda t: regexp_matches(lower(t), '^(hkcu|hklm)\\software\\microsoft\\windows\\currentversion\\run'))) > 0)",
    "enumerates_identity": f"(exe IN ('whoami', 'id') OR (exe = 'net' AND {_SUB('user')} AND NOT {_FAR}))",
    "enumerates_network_config": f"(exe IN ('ipconfig', 'ifconfig', 'ip', 'netstat', 'ss', 'route', 'arp', 'hostname', 'nslookup', 'dig') OR (exe = 'net' AND {_SUB('view', 'use', 'share')}))",
    "enumerates_users_or_groups": f"((exe = 'net' AND {_SUB('user', 'group', 'localgroup')}) OR exe = 'dsquery' OR (exe = 'getent' AND {_HAS('args', 'passwd', 'group')}))",
    "uses_signed_proxy_binary": "(lolbin OR exe IN ('certutil', 'mshta', 'rundll32', 'regsvr32', 'wmic', 'bitsadmin', 'powershell', 'powershell.exe', 'cmd', 'cmd.exe'))",
    "remote_execution_or_session": f"((exe IN ('wmic', 'psexec', 'winrs', 'ssh', 'scp', 'sftp') AND {_FAR}) OR (exe = 'wmic' AND {_SUB('process')}))",
    "service_control": "exe IN ('sc', 'sc.exe', 'systemctl', 'service')",
    "creates_or_modifies_service": f"(exe IN ('sc', 'sc.exe', 'systemctl') AND {_SUB('create', 'config', 'enable', 'link')})",
    "reads_credential_store": r"(exe IN ('mimikatz', 'procdump', 'procdump.exe') OR len(list_filter(list_concat(paths, regs), lambda t: regexp_matches(lower(t), '/etc/shadow|/etc/passwd|sam|ntds\.dit|lsass|security|policy\\secrets'))) > 0)",
    "deletes_shadow_copies": f"(exe IN ('vssadmin', 'wmic') AND ({_SUB('delete')} OR {_HAS('args', 'delete')}) AND ({_HAS('args', 'shadows')} OR contains(lower(x), 'shadowcopy')))",
}


def featured(spark, sf_dir) -> DataFrame:
    return triage.with_semantics(parsed(spark, sf_dir))


@query(PARSED + " SELECT event_id, " + ", ".join(f"{sql} AS {name}" for name, sql in FEATURES.items()) + " FROM p")
def sem1_sem24_features(spark, sf_dir):
    return featured(spark, sf_dir).select("event_id", *FEATURES)


@query(PARSED + f", fl AS (SELECT host_id, {', '.join(f'{sql} AS {name}' for name, sql in FEATURES.items())} FROM p) SELECT host_id, count(*) AS n_commands, {', '.join(f'CAST(sum(CAST({name} AS BIGINT)) AS BIGINT) AS {name}' for name in FEATURES)} FROM fl GROUP BY 1")
def flagship_triage(spark, sf_dir):
    """What each host runs: its commands and how many have each feature."""
    return featured(spark, sf_dir).groupBy("host_id").agg(F.count("*").alias("n_commands"), *[F.sum(F.col(name).cast("long")).alias(name) for name in FEATURES])


_TAGS = "list_filter([" + ", ".join(f"CASE WHEN {FEATURES[n]} THEN '{n}' END" for n in triage.TAG_ORDER) + "], lambda m: m IS NOT NULL)"


@query(PARSED + f" SELECT event_id, array_to_string({_TAGS}, ' ') AS feature_tags, len(flags) AS n_flags, len(urls) AS n_urls, len(paths) AS n_file_paths, len(regs) AS n_registry_paths FROM p")
def sem25_sem26_tags(spark, sf_dir):
    sizes = [F.col(f"debug_context.{n}").cast("long").alias(n) for n in ("n_flags", "n_urls", "n_file_paths", "n_registry_paths")]
    return featured(spark, sf_dir).select("event_id", F.array_join("feature_tags", " ").alias("feature_tags"), *sizes)


_AROUND = "chr(31) || lower(array_to_string({0}, chr(31))) || chr(31)"
RULED = (
    PARSED + ", s AS (SELECT *, " + ", ".join(f"{sql} AS {name}" for name, sql in FEATURES.items()) + f", coalesce(sub0, '') AS sub, lower(x) AS norm, {_AROUND.format('flags')} AS flags_s, {_AROUND.format('args')} AS args_s, {_AROUND.format('paths')} AS paths_s, "
    "len(paths) AS n_paths, len(regs) AS n_regs, CAST(lolbin AS INTEGER) AS n_lolbins, '' AS decoded FROM p)"
)
_EFFECTS = lambda rules: ", ".join(f"CASE WHEN {cond} THEN {{'c': '{c}', 'w': CAST({w} AS DOUBLE), 'k': {str(k).lower()}}} END" for _, _, cond, c, w, k in rule_table.effects(rules))
_FIRED = lambda rules: ", ".join(f"CASE WHEN {cond} THEN {{'r': '{r}', 's': {str(s).lower()}}} END" for r, s, cond in rule_table.fired(rules))
_FIRST, _LAST = rule_table.RULES[:-1], rule_table.RULES[-1:]
EFFECTS = (
    RULED + f", e1 AS (SELECT event_id, unnest([{_EFFECTS(_FIRST)}]) AS e FROM s), t1 AS (SELECT event_id, e.c AS c, least(1.0, sum(e.w)) AS w FROM e1 WHERE e IS NOT NULL GROUP BY 1, 2), top AS (SELECT event_id, max(w) AS w FROM t1 GROUP BY 1), "
    f"open_ AS (SELECT s.* FROM s LEFT JOIN top USING (event_id) WHERE coalesce(top.w, 0) <= 0.5), e2 AS (SELECT event_id, unnest([{_EFFECTS(_LAST)}]) AS e FROM open_), ef AS (SELECT event_id, e.c AS class, e.w AS w, e.k AS k FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2) WHERE e IS NOT NULL)"
)


def ruled(spark, sf_dir, more=lambda df: df) -> DataFrame:
    """The gallery with its rules and what ``more`` makes of them and the command alone; a command is judged once however many events run it."""
    made = lambda df: more(triage.with_rules(triage.with_semantics(triage.parse_commands(df, quotes=False))))
    return triage.once_per_command(gallery(spark, sf_dir), made)


@query(EFFECTS + " SELECT event_id, class, round(least(1.0, sum(w)), 6) AS prior FROM ef WHERE w > 0 GROUP BY 1, 2")
def rul1_rul36_priors(spark, sf_dir):
    # outer: a plain explode would push a test of the map below the projections and write all rules out into it
    rows = ruled(spark, sf_dir).select("event_id", F.explode_outer("priors").alias("class", "prior"))
    return rows.filter("class is not null").select("event_id", "class", F.round("prior", 6).alias("prior"))


@query(
    RULED + f", top AS (SELECT event_id, max(w) AS w FROM (SELECT event_id, e.c AS c, least(1.0, sum(e.w)) AS w FROM (SELECT event_id, unnest([{_EFFECTS(_FIRST)}]) AS e FROM s) WHERE e IS NOT NULL GROUP BY 1, 2) GROUP BY 1), "
    f"r AS (SELECT event_id, unnest([{_FIRED(_FIRST)}]) AS r FROM s UNION ALL SELECT event_id, unnest([{_FIRED(_LAST)}]) FROM s LEFT JOIN top USING (event_id) WHERE coalesce(top.w, 0) <= 0.5) "
    "SELECT g.event_id, coalesce(array_to_string(list_sort(list(r.r.r) FILTER (r.r IS NOT NULL)), ' '), '') AS fired_rules, CASE WHEN coalesce(bool_or(r.r.s), false) THEN 'strong' WHEN count(r.r) > 0 THEN 'weak' ELSE 'none' END AS rule_strength FROM g LEFT JOIN r USING (event_id) GROUP BY 1"
)
def rul0_fired_rules(spark, sf_dir):
    return ruled(spark, sf_dir).select("event_id", F.array_join(F.array_sort("fired_rules"), " ").alias("fired_rules"), "rule_strength")


@query(
    EFFECTS + ", bn AS (SELECT event_id, deletes_shadow_copies AS banning FROM s) SELECT bn.event_id, coalesce(array_to_string(list_sort(list(DISTINCT class) FILTER (k AND NOT (banning AND class IN "
    + _any((rule_table.INGRESS, rule_table.RUN_KEY, rule_table.TASK)) + "))), ' '), '') AS candidates, "
    "CASE WHEN any_value(banning) THEN 3 ELSE 0 END AS n_banned FROM bn LEFT JOIN ef USING (event_id) GROUP BY 1"
)
def rul0_candidates(spark, sf_dir):
    return ruled(spark, sf_dir).select("event_id", F.array_join(F.array_sort("candidate_classes"), " ").alias("candidates"), F.size("banned_classes").alias("n_banned"))


@query(
    RULED + " SELECT exe AS executable, count(*) AS n, " + ", ".join(f"CAST(sum(CAST({n} AS BIGINT)) AS BIGINT) AS {n}" for n in FEATURES) + " FROM s GROUP BY 1"
)
def sem_profile_by_tool(spark, sf_dir):
    return featured(spark, sf_dir).groupBy("executable").agg(F.count("*").alias("n"), *[F.sum(F.col(n).cast("long")).alias(n) for n in FEATURES])


_SEGMENTS = r"regexp_split_to_array(command, '\|\||&&|;|\||&')"


@query(
    f"WITH g AS ({GALLERY_SQL}), a AS (SELECT event_id, unnest({_SEGMENTS}) AS seg FROM g WHERE NOT contains(command, '&>')), "
    r"b AS (SELECT event_id, list_filter(regexp_split_to_array(regexp_replace(trim(seg), '^((([A-Za-z_][A-Za-z0-9_]*=\S*)|sudo|env|nohup|time|exec|command|nice|xargs)(\s+|$))+', ''), '\s+'), lambda w: w <> '') AS w FROM a), "
    rf"c AS (SELECT event_id, {_BASE.format('trim(w[1], chr(34) || chr(39) || ' + chr(39) + '(){}' + chr(39) + ')')} AS bin, list_filter(w[2:], lambda t: starts_with(t, '-') OR (starts_with(t, '/') AND length(t) <= 3)) AS flags FROM b WHERE len(w) > 0) "
    "SELECT event_id, bin AS \"binary\", array_to_string(list_sort(list_distinct(flatten(list(flags)))), ' ') AS flags, bin IN " + _any(rule_table.LOLBIN_CANDIDATES)
    + " AS lolbin, bin IN " + _any((*parsing.INTERPRETERS, "mshta", "mshta.exe")) + r" AS interpreter FROM c WHERE regexp_matches(bin, '^[\w.+-]+$') GROUP BY 1, 2"
)
def par20_binary_inventory(spark, sf_dir):
    found = triage.binary_inventory(gallery(spark, sf_dir), "event_id")
    return found.select("event_id", "binary", F.array_join(F.array_sort("flags"), " ").alias("flags"), F.array_contains("roles", "lolbin").alias("lolbin"), F.array_contains("roles", "interpreter").alias("interpreter"))
