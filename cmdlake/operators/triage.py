"""Commands as structured rows: parsed fields, behaviour features, rule verdicts, in three stages.

Each stage adds plain columns in one or a few projections, later ones built on columns of
earlier ones, so that a token list is made once a row however many fields read it.  Only
commands with quotes and no sign of Windows pass through an Arrow function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdlake.functions import parsing, rule_table
from cmdlake.functions.parsing import all_of, is_file, is_flag, is_remote, marks
from cmdlake.functions.text import collapse

# Fixed values.
SUBCOMMAND_TOOLS = ("docker", "kubectl", "git", "reg", "sc", "systemctl", "wmic", "net", "aws", "gcloud", "az")
SHADOW_VERBS = ("create", "delete", "list", "resize")
DOMAIN = r"(?i)\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}\b"
FILE_LIKE = r"\.(exe|dll|bat|cmd|ps1|sh|py|zip|tar|gz|tgz|7z|rar|txt|log|json|yaml|yml|cfg|conf|pdf|bin|dat|tmp|hta|vbs|js|jar|msi|iso|img)$"
WINDOWS_EXECUTABLES = (
    "powershell", "powershell.exe", "pwsh", "cmd", "cmd.exe", "reg", "reg.exe", "schtasks", "schtasks.exe", "wmic", "wmic.exe", "certutil", "certutil.exe", "mshta", "mshta.exe",
    "rundll32", "rundll32.exe", "vssadmin", "vssadmin.exe", "bitsadmin", "bitsadmin.exe", "ipconfig", "ipconfig.exe", "net", "net.exe", "sc", "sc.exe", "wscript", "wscript.exe", "cscript", "cscript.exe",
)
AUTORUN = r"^(hkcu|hklm)\\software\\microsoft\\windows\\currentversion\\run"
EXECUTABLE_SUFFIX = r"(?i)\.(exe|dll|bat|cmd|ps1|vbs|js|hta|sh|py|jar)$"
CREDENTIAL_HINT = r"(?i)/etc/shadow|/etc/passwd|sam|ntds\.dit|lsass|security|policy\\secrets"
GUID, HEX = r"\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b", r"\b(?:0x[0-9a-fA-F]+|[0-9a-fA-F]{32,64})\b"
TAG_ORDER = (
    "downloads_remote_resource", "transfers_file_to_remote", "writes_local_file", "writes_executable_like_file", "has_remote_target", "has_local_target", "archive_create", "archive_extract",
    "compression_or_archiving", "creates_scheduled_task", "modifies_registry_autorun", "enumerates_identity", "enumerates_network_config", "enumerates_users_or_groups", "uses_encoded_payload", "uses_obfuscation",
    "executes_inline_code", "runs_interpreter", "uses_signed_proxy_binary", "remote_execution_or_session", "service_control", "creates_or_modifies_service", "reads_credential_store", "deletes_shadow_copies",
)

clean = lambda t: F.regexp_replace(t, "^[\"']+|[\"']+$", "")
base_name = lambda t: F.lower(F.element_at(F.split(t, "/"), -1))
kept = lambda items: F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""))


def parse_commands(df: DataFrame, command: str = "command", decoded: str | None = None, quotes: bool = True) -> DataFrame:
    """df with the fields of each command; targets and indicators come from the decoded form where there is one.

    Null commands have null fields; a command of white space has an empty executable.
    """
    seen = collapse(F.col(command))
    target = seen if decoded is None else F.when(F.col(decoded).isNotNull() & (F.col(decoded) != seen), F.col(decoded))
    df = df.withColumns({"text": seen, "deobfuscated_command": F.lit(None).cast("string") if decoded is None else target})
    df = df.withColumns({"target": F.coalesce("deobfuscated_command", "text"), "tokens": parsing.tokens(F.col("text"), quotes)})
    df = df.withColumn("target_tokens", F.col("tokens") if decoded is None else F.when(F.col("deobfuscated_command").isNull(), F.col("tokens")).otherwise(parsing.tokens(F.col("target"), quotes)))
    df = df.withColumn("real", F.filter("tokens", lambda t: ~t.isin(*parsing.OPERATORS)))
    df = df.withColumns({"executable": F.coalesce(base_name(clean(F.try_element_at("real", F.lit(1)))), F.when(F.col("text").isNotNull(), "")), "second": clean(F.try_element_at("real", F.lit(2)))})
    verb = F.col("executable").isin(*SUBCOMMAND_TOOLS) | (F.col("executable") == "vssadmin") & F.col("second").isin(*SHADOW_VERBS)
    df = df.withColumn("subcommand", F.when(~is_flag(F.col("second")) & (F.col("second") != "") & verb, F.lower("second")))
    df = df.withColumn("rest", F.transform(F.slice("real", F.when(F.col("subcommand").isNull(), 2).otherwise(3), F.lit(1 << 20)), clean))
    text = F.col("target")
    df = df.withColumns({
        "flags": kept(F.filter("rest", is_flag)), "positional_args": kept(F.filter("rest", lambda t: ~is_flag(t))),
        "pipe_operators": F.filter(all_of(text, r"\|+"), lambda x: x == "|"), "redirect_operators": all_of(text, parsing.REDIRECT), "chain_operators": all_of(text, parsing.CHAIN),
        "urls": F.array_distinct(all_of(text, parsing.URL)), "ips": parsing.valid_ips(text), "registry_paths": F.array_distinct(all_of(text, parsing.REGISTRY)),
        "encoded_markers": marks(F.col("text"), parsing.ENCODED), "obfuscation_markers": marks(F.col("text"), parsing.OBFUSCATED),
    })
    df = df.withColumn("operands", F.filter(F.transform("target_tokens", clean), lambda t: ~t.isin(*parsing.OPERATORS) & ~is_flag(t) & ~F.array_contains("urls", t)))
    df = df.withColumns({"remote_tokens": kept(F.filter("operands", is_remote)), "file_paths": kept(F.filter("operands", lambda t: ~is_remote(t) & is_file(t)))})
    known = F.create_map(*[F.lit(x) for kv in parsing.INTERPRETERS.items() for x in kv])
    exe, host = F.col("executable"), lambda u: F.split(F.element_at(F.split(F.split(F.regexp_replace(u, r"(?i)^[a-z]+://", ""), "/")[0], "@"), -1), ":")[0]
    found = F.concat(F.filter(all_of(text, DOMAIN), lambda d: ~d.rlike(r"(^|\.)[A-Z]")), F.transform("urls", host))
    names = F.filter(F.transform(found, lambda d: F.regexp_replace(F.lower(d), r"^\.+|\.+$", "")), lambda d: (d != "") & ~d.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$") & ~d.rlike(FILE_LIKE) & ~F.array_contains("ips", d))
    dashed = lambda letter: (exe == "tar") & F.exists("tokens", lambda t: t.startswith("-") & F.contains(F.lower(t), F.lit(letter)))
    df = df.withColumns({
        "domains": F.array_distinct(names), "ports": parsing.ports(text),
        "local_targets": F.array_distinct(F.concat("file_paths", "registry_paths")), "remote_targets": F.array_distinct(F.concat("urls", "remote_tokens")),
        "interpreter_markers": F.array_distinct(F.array_compact(F.transform(F.filter("tokens", lambda t: ~is_flag(t)), lambda t: F.try_element_at(known, base_name(t))))),
        "platform": F.when((F.size("registry_paths") > 0) | exe.isin(*WINDOWS_EXECUTABLES) | exe.endswith(".exe"), "windows").when(exe.isin(*parsing.LINUX_TOOLS), "linux")
        .when(F.exists("flags", lambda f: f.startswith("/")), "windows").otherwise("unknown"),
        "archive_indicators": F.array_distinct(F.array_compact(F.array(
            F.when(exe.isin(*parsing.ARCHIVERS), "archive_tool"), F.when(dashed("x"), "archive_extract"), F.when(dashed("c"), "archive_create"), F.when(dashed("z"), "compression_gzip"),
            F.when(exe.isin("zip", "7z", "7za", "rar", "gzip"), "archive_create"), F.when(exe.isin("unzip", "unrar", "gunzip"), "archive_extract"),
            F.when(F.exists("tokens", lambda t: t.rlike(parsing.ARCHIVE_SUFFIX)), "archive_path"), F.when(F.contains(F.lower(F.array_join("tokens", " ")), F.lit("backup")), "backup_keyword"),
        ))),
        "lolbin_matches": F.when(exe.isin(*parsing.PROXY_WINDOWS, *parsing.PROXY_LINUX), F.array(exe)).otherwise(F.array().cast("array<string>")),
        "inline_code": F.exists("flags", lambda f: F.lower(f).isin(*parsing.INLINE_FLAGS)),
        "has_pipe": F.size("pipe_operators") > 0, "has_redirect": F.size("redirect_operators") > 0, "has_chain": F.size("chain_operators") > 0,
    })
    return df.drop("target_tokens", "real", "second", "rest", "operands", "target")


def once_per_command(df: DataFrame, made: Callable[[DataFrame], DataFrame], command: str = "command") -> DataFrame:
    """df with the columns of ``made``, which gets each distinct command once, as the only column, and keeps that column.

    For stages whose results depend on the command alone: their work then grows with the commands that differ, not with
    how often they ran.  A command takes as many rows as ``made`` gives it; columns of equal names are replaced.
    """
    each = made(df.select(command).distinct())
    key = command + "_"
    while key in (*df.columns, *each.columns):
        key += "_"
    rows = df.drop(*[c for c in each.columns if c != command])
    each = each.withColumnRenamed(command, key)
    return rows.join(each, rows[command].eqNullSafe(each[key])).drop(key)


def any_in(names: str, *values: str) -> Column:
    """Whether a lower-cased member of an array column is one of the values."""
    return F.exists(names, lambda x: F.lower(x).isin(*values))


def with_semantics(df: DataFrame) -> DataFrame:
    """parse_commands' rows with the 24 features as columns, feature_tags and debug_context."""
    exe, sub, norm = F.col("executable"), F.coalesce("subcommand", F.lit("")), F.lower("text")
    df = df.withColumns({
        "has_remote_target": (F.size("remote_targets") > 0) | (F.size("urls") > 0),
        "has_local_target": (F.size("local_targets") > 0) | (F.size("file_paths") > 0) | (F.size("registry_paths") > 0),
        "writes_local_file": F.size("file_paths") > 0, "writes_executable_like_file": F.exists("file_paths", lambda p: p.rlike(EXECUTABLE_SUFFIX)),
        "archive_create": F.array_contains("archive_indicators", "archive_create"), "archive_extract": F.array_contains("archive_indicators", "archive_extract"),
    })
    far = F.col("has_remote_target")
    df = df.withColumns({
        "downloads_remote_resource": exe.isin("curl", "wget", "certutil", "bitsadmin", "powershell", "powershell.exe") & far,
        "transfers_file_to_remote": exe.isin("scp", "rsync", "sftp") & far | (far & F.exists("remote_targets", lambda t: t.contains("@")) & exe.isin("scp", "ssh", "rsync")),
        "executes_inline_code": F.col("inline_code") | (F.size("interpreter_markers") > 0) & any_in("flags", *parsing.INLINE_FLAGS),
        "uses_encoded_payload": F.size("encoded_markers") > 0, "uses_obfuscation": F.size("obfuscation_markers") > 0,
        "creates_scheduled_task": exe.isin("schtasks", "schtasks.exe", "at", "cron", "crontab", "launchctl", "systemd-run") & (sub.isin("add", "create") | any_in("flags", "/create") | any_in("positional_args", "create")),
        "modifies_registry_autorun": exe.isin("reg", "reg.exe") & sub.isin("add", "delete", "import") & F.exists("registry_paths", lambda p: F.lower(p).rlike(AUTORUN)),
        "enumerates_identity": exe.isin("whoami", "id") | (exe == "net") & (sub == "user") & ~far,
        "enumerates_network_config": exe.isin("ipconfig", "ifconfig", "ip", "netstat", "ss", "route", "arp", "hostname", "nslookup", "dig") | (exe == "net") & sub.isin("view", "use", "share"),
        "enumerates_users_or_groups": (exe == "net") & sub.isin("user", "group", "localgroup") | (exe == "dsquery") | (exe == "getent") & any_in("positional_args", "passwd", "group"),
        "uses_signed_proxy_binary": exe.isin("certutil", "mshta", "rundll32", "regsvr32", "wmic", "bitsadmin", "powershell", "powershell.exe", "cmd", "cmd.exe") | (F.size("lolbin_matches") > 0),
        "remote_execution_or_session": exe.isin("wmic", "psexec", "winrs", "ssh", "scp", "sftp") & far | (exe == "wmic") & (sub == "process"),
        "service_control": exe.isin("sc", "sc.exe", "systemctl", "service"),
        "creates_or_modifies_service": exe.isin("sc", "sc.exe", "systemctl") & (sub.isin("create", "config", "enable", "link") | any_in("flags", "create", "config")),
        "reads_credential_store": F.exists(F.concat("file_paths", "local_targets"), lambda p: p.rlike(CREDENTIAL_HINT)) | exe.isin("mimikatz", "procdump", "procdump.exe"),
        "deletes_shadow_copies": exe.isin("vssadmin", "wmic") & ((sub == "delete") | any_in("positional_args", "delete")) & (any_in("positional_args", "shadows") | F.contains(norm, F.lit("shadowcopy"))),
        "runs_interpreter": F.size("interpreter_markers") > 0,
        "compression_or_archiving": (F.size("archive_indicators") > 0) | exe.isin(*parsing.ARCHIVERS) | F.exists("file_paths", lambda p: p.rlike(parsing.ARCHIVE_SUFFIX)),
    })
    return df.withColumns({
        "feature_tags": F.array_compact(F.array(*[F.when(F.col(n), n) for n in TAG_ORDER])),
        "debug_context": F.struct("executable", "subcommand", F.size("flags").alias("n_flags"), F.size("urls").alias("n_urls"), F.size("file_paths").alias("n_file_paths"), F.size("registry_paths").alias("n_registry_paths"), F.col("deobfuscated_command").isNotNull().alias("was_deobfuscated")),
    })


def rule_inputs(df: DataFrame) -> DataFrame:
    """with_semantics' rows with the scalar columns that the rule table's conditions name."""
    around = lambda items: F.concat(F.lit("\x1f"), F.lower(F.array_join(items, "\x1f")), F.lit("\x1f"))
    return df.withColumns({
        "exe": F.col("executable"), "sub": F.coalesce("subcommand", F.lit("")), "norm": F.lower("text"), "flags_s": around("flags"), "args_s": around("positional_args"), "paths_s": around("file_paths"),
        "n_paths": F.size("file_paths"), "n_regs": F.size("registry_paths"), "n_lolbins": F.size("lolbin_matches"), "decoded": F.coalesce("deobfuscated_command", F.lit("")),
        "source": F.coalesce(F.try_element_at("urls", F.lit(1)), F.try_element_at("ips", F.lit(1)), F.lit("<unknown>")), "reg_s": F.array_join("registry_paths", ", "), "enc_s": F.array_join("encoded_markers", ", "),
        "first_remote": F.coalesce(F.try_element_at("remote_targets", F.lit(1)), F.lit("<unknown>")),
    })


def with_rules(df: DataFrame) -> DataFrame:
    """with_semantics' rows with candidate_classes, banned_classes, priors (capped at 1), evidence, fired_rules and rule_strength.

    Every rule's condition is a column first, so that its priors, evidence and bans read it instead of repeating it.
    Write the result, or aggregate it, before filtering by it: Catalyst would push such a filter below the projections
    and write every rule out into it.
    """
    when = lambda r: f"r_{r.name}"
    made = lambda rows: F.array_compact(F.array(*[F.when(F.expr(cond), F.expr(value)) for cond, value in rows]))
    df = rule_inputs(df)
    df = df.withColumns({when(r): F.expr(r.when) for r in rule_table.RULES})
    prior = lambda name: lambda c: F.least(F.lit(1.0), F.aggregate(name, F.lit(0.0), lambda a, e: a + F.when(e["c"] == c, e["w"]).otherwise(0.0)))
    added = lambda name: F.array_distinct(F.transform(F.filter(name, lambda e: e["w"] > 0), lambda e: e["c"]))
    first, last = rule_table.RULES[:-1], rule_table.RULES[-1:]
    shape = lambda rules: [(cond, f"named_struct('c', '{c}', 'w', {w}D, 'k', {str(k).lower()})") for _, _, cond, c, w, k in rule_table.effects(rules, when)]
    names = lambda rules: [(cond, f"named_struct('r', '{r}', 's', {str(s).lower()})") for r, s, cond in rule_table.fired(rules, when)]
    df = df.withColumns({"effects": made(shape(first)), "fired": made(names(first)), "evidence": made(rule_table.evidence(first, when)), "banned_classes": made([(cond, f"'{c}'") for cond, c in rule_table.bans(when)])})
    df = df.withColumn("classes", added("effects"))
    # the last rule looks at what the others gave
    df = df.withColumn("unsure", F.coalesce(F.array_max(F.transform("classes", prior("effects"))), F.lit(0.0)) <= 0.5)
    df = df.withColumns({x: F.concat(x, F.when(F.col("unsure"), made(rows)).otherwise(F.array())) for x, rows in (("effects", shape(last)), ("fired", names(last)), ("evidence", rule_table.evidence(last, when)))})
    df = df.withColumn("classes", added("effects"))
    df = df.withColumns({
        "candidate_classes": F.filter(F.array_distinct(F.transform(F.filter("effects", lambda e: e["k"]), lambda e: e["c"])), lambda c: ~F.array_contains("banned_classes", c)),
        "priors": F.map_from_arrays("classes", F.transform("classes", prior("effects"))), "fired_rules": F.transform("fired", lambda r: r["r"]),
        "rule_strength": F.when(F.exists("fired", lambda r: r["s"]), "strong").when(F.size("fired") > 0, "weak").otherwise("none"),
    })
    return df.drop("exe", "sub", "norm", "flags_s", "args_s", "paths_s", "n_paths", "n_regs", "n_lolbins", "decoded", "source", "reg_s", "enc_s", "first_remote", "effects", "fired", "classes", "unsure", *map(when, rule_table.RULES))


def signature(command: str = "command") -> Column:
    """struct(executable, verb, flag_set, typed_slots, raw_signature) of a row of parse_commands: what is alike in every run of a command."""
    canon = lambda t: F.regexp_replace(F.lower(F.trim(clean(F.trim(t)))), "^[-/]+", "")
    words = all_of(F.col(command), parsing.TOKEN)
    flag = lambda t: t.startswith("-") | t.startswith("/")
    after = lambda i: clean(F.try_element_at(words, i + 2))
    each = F.transform(words, lambda t, i: F.when(flag(t) & (canon(t) != ""), F.array(canon(t), F.when((after(i) != "") & ~flag(after(i)), F.concat(canon(t), F.lit(":"), canon(after(i)))))))
    flags = F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.array_compact(each)))))
    low = lambda p: F.lower(p)
    place = lambda p: (
        F.when(low(p).rlike(r"windows\\system32|/system32/|\\system32\\|/syswow64/|\\syswow64\\"), "<PATH:system32>")
        .when(low(p).rlike(r"users\\public|/public/|\\public\\|programdata|temp|/tmp/"), "<PATH:users_public>")
        .when(low(p).rlike(r"^(c:\\|/|~)"), "<PATH:abs>").otherwise("<PATH:relative>")
    )
    masked = lambda a: F.regexp_replace(F.regexp_replace(F.regexp_replace(a, GUID, "<GUID>"), HEX, "<HEX>"), r"\b\d+\b", "<NUM>")
    slot = lambda a: F.when(low(a).rlike("^https?://"), "<URL>").when(low(a).rlike("^(powershell|cmd|python|-encodedcommand|-command)"), "<CMD>").otherwise(masked(a))
    several = lambda items, name: F.when(F.size(items) > 0, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    slots = F.array_sort(F.array_distinct(F.concat(F.transform("file_paths", place), several("urls", "<URL>"), several("ips", "<IP>"), several("registry_paths", "<REGKEY>"), F.transform("positional_args", slot))))
    exe = F.when(F.col("executable") == "", "unknown").otherwise(F.col("executable"))
    text = F.concat_ws("|", exe, F.coalesce("subcommand", F.lit("*")), F.array_join(flags, ","), F.array_join(slots, ","))
    return F.struct(exe.alias("executable"), F.col("subcommand").alias("verb"), flags.alias("flag_set"), slots.alias("typed_slots"), text.alias("raw_signature"))


def binary_inventory(df: DataFrame, key: str, command: str = "command") -> DataFrame:
    """key, binary, flags, roles: each binary that a command's pipe and chain segments run."""
    bare = r"^(?:(?:[A-Za-z_][A-Za-z0-9_]*=\S*|(?i:sudo|env|nohup|time|exec|command|nice|xargs))(?:\s+|$))+"
    parts = df.select(key, F.posexplode(F.split(command, r"\|\||&&|;|\||&(?!>)")).alias("place", "segment"))
    words = parts.withColumn("words", F.filter(F.split(F.regexp_replace(F.regexp_replace("segment", r"^\s+|\s+$", ""), bare, ""), r"\s+"), lambda w: w != "")).filter(F.size("words") > 0)
    named = words.withColumn("binary", base_name(F.regexp_replace(F.col("words")[0], r"^[\"'(){}]+|[\"'(){}]+$", ""))).filter(F.col("binary").rlike(r"^[\w.+-]+$"))
    flags = named.select(key, "place", "binary", F.filter(F.slice("words", 2, 1 << 20), lambda t: t.startswith("-") | (t.startswith("/") & (F.length(t) <= 3))).alias("flags"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "flags"))), lambda x: x["flags"])
    roles = F.array_compact(F.array(F.when(F.col("binary").isin(*rule_table.LOLBIN_CANDIDATES), "lolbin"), F.when(F.col("binary").isin(*parsing.INTERPRETERS, "mshta", "mshta.exe"), "interpreter")))
    return flags.groupBy(key, "binary").agg(F.array_distinct(F.flatten(ordered)).alias("flags")).withColumn("roles", roles)
