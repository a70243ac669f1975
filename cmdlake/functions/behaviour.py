"""Behaviour of a command: action tags, stage, intent bucket, residual text and the texts that models read.

All functions are expressions over the columns that triage.with_rules adds and the has_* columns of
routing.routing_features.  Tables of names are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cmdlake.operators.curation import semantic_tags

# Column and action tag.
ACTIONS = (
    ("downloads_remote_resource", "download_remote_resource"), ("transfers_file_to_remote", "transfer_file_remote"), ("creates_scheduled_task", "establish_persistence"), ("modifies_registry_autorun", "establish_persistence"),
    ("creates_or_modifies_service", "establish_persistence"), ("remote_execution_or_session", "remote_session"), ("enumerates_identity", "enumerate_identity"), ("enumerates_network_config", "enumerate_network"),
    ("reads_credential_store", "access_credential_store"), ("deletes_shadow_copies", "delete_shadow_copies"), ("uses_encoded_payload", "encode_payload"), ("uses_obfuscation", "obfuscate_command"),
    ("runs_interpreter", "run_script_interpreter"), ("executes_inline_code", "execute_inline_code"), ("uses_signed_proxy_binary", "use_signed_proxy"), ("archive_create", "archive_or_stage_data"),
    ("archive_extract", "extract_archive"), ("writes_executable_like_file", "drop_executable"),
    ("has_pipe_to_shell", "pipe_to_shell"), ("has_reverse_shell_pattern", "reverse_shell"), ("has_download", "download_remote_resource"), ("has_remote_transfer", "transfer_file_remote"), ("has_sensitive_file_read", "access_sensitive_file"),
    ("has_persistence_change", "establish_persistence"), ("has_privilege_escalation", "attempt_privilege_escalation"), ("has_defense_impairment", "disable_defenses"), ("has_destructive_write", "destructive_write"),
    ("has_archive_or_bulk_copy", "archive_or_stage_data"), ("has_tunneling", "establish_tunnel"), ("has_exfil_data_movement", "exfiltrate_data"), ("has_enumeration_recon", "enumerate_environment"), ("has_exploit_or_attack_tooling", "use_attack_tooling"),
)
RULE_ACTIONS = {
    "curl_pipe_shell": "pipe_to_shell", "reverse_shell": "reverse_shell", "shadow_copy_delete": "delete_shadow_copies", "certutil_download": "download_remote_resource", "bitsadmin_download": "download_remote_resource",
    "encoded_ps_inline": "encode_payload", "powershell_enc": "encode_payload", "mshta_inline": "use_signed_proxy", "schtasks_create": "establish_persistence", "registry_autorun": "establish_persistence",
    "recon_whoami": "enumerate_identity", "recon_net_user": "enumerate_identity", "recon_ipconfig": "enumerate_network",
}
#: The first stage one of whose columns holds.
STAGES = (
    ("Impact", ("has_destructive_write", "deletes_shadow_copies")), ("Credential Access", ("has_credential_dumping_pattern", "reads_credential_store")), ("Privilege Escalation", ("has_privilege_escalation",)),
    ("Persistence", ("has_persistence_change", "creates_scheduled_task", "modifies_registry_autorun")), ("Exfiltration", ("has_exfil_data_movement",)), ("Payload Retrieval", ("has_remote_transfer", "downloads_remote_resource")),
    ("C2 / Remote Access", ("has_tunneling", "has_reverse_shell_pattern", "remote_execution_or_session")), ("Discovery / Recon", ("has_enumeration_recon", "enumerates_identity", "enumerates_network_config")),
    ("Defense Evasion", ("has_base64_or_encoded_exec", "uses_encoded_payload", "uses_obfuscation")), ("Execution", ("runs_interpreter", "executes_inline_code", "has_shell_spawn")),
)
HIGH_SIGNAL = ("executes_inline_code", "uses_encoded_payload", "uses_obfuscation", "reads_credential_store", "creates_scheduled_task", "modifies_registry_autorun", "deletes_shadow_copies")
IN_CONTEXT = (
    "enumerates_identity", "enumerates_network_config", "enumerates_users_or_groups", "downloads_remote_resource", "transfers_file_to_remote", "remote_execution_or_session", "runs_interpreter", "uses_signed_proxy_binary",
)
# Weak labels of stages and actions.
TECHNIQUE_STAGE = {"T1105": "Payload Retrieval"}
RULE_STAGE = {"archive_collected_data": "Collection / Staging", "credential_access": "Credential Access", "credential_dumping": "Credential Access", "exfiltration": "Exfiltration", "ingress_tool_transfer": "Payload Retrieval"}
TACTIC_STAGE = {
    "Reconnaissance": "Discovery / Recon", "Discovery": "Discovery / Recon", "Execution": "Execution", "Persistence": "Persistence", "Privilege Escalation": "Privilege Escalation", "Defense Evasion": "Defense Evasion",
    "Credential Access": "Credential Access", "Collection": "Collection / Staging", "Command and Control": "C2 / Remote Access", "Lateral Movement": "Lateral Movement", "Exfiltration": "Exfiltration", "Impact": "Impact", "Initial Access": "Context Required",
}
TAG_ACTION = {"ENCODED_PAYLOAD": "use_encoded_payload", "INLINE_EXEC": "execute_inline_code", "PIPE": "pipe_data", "ARCHIVE_CREATE": "archive_data", "ARCHIVE_EXTRACT": "extract_archive"}
CLASS_ACTION = {
    "obfuscated_files_or_information": "use_obfuscation", "command_and_scripting_interpreter": "execute_interpreter", "signed_binary_proxy_execution": "use_signed_proxy_binary", "remote_services": "remote_execution",
    "ingress_tool_transfer": "download_remote_resource", "archive_collected_data": "archive_data",
}
# Residual text: tokens by tool, by tool and subcommand, by registry path, by file suffix; masks in order.
TOOL_TOKENS = {
    "curl": "TRANSFER", "wget": "TRANSFER", "certutil": "TRANSFER", "bitsadmin": "TRANSFER", "invoke-webrequest": "TRANSFER", "invoke-restmethod": "TRANSFER", "start-bitstransfer": "TRANSFER", "scp": "TRANSFER",
    "sftp": "TRANSFER", "reg": "REGISTRY", "reg.exe": "REGISTRY", "set-itemproperty": "REGISTRY", "new-itemproperty": "REGISTRY", "remove-itemproperty": "REGISTRY", "get-itemproperty": "REGISTRY", "schtasks": "SCHED_TASK",
    "schtasks.exe": "SCHED_TASK", "at": "SCHED_TASK", "at.exe": "SCHED_TASK", "crontab": "SCHED_TASK", "sc": "SERVICE", "sc.exe": "SERVICE", "systemctl": "SERVICE", "service": "SERVICE", "new-service": "SERVICE",
    "set-service": "SERVICE", "powershell": "POWERSHELL", "powershell.exe": "POWERSHELL", "pwsh": "POWERSHELL", "pwsh.exe": "POWERSHELL", "cmd": "CMD_SHELL", "cmd.exe": "CMD_SHELL", "bash": "SHELL", "sh": "SHELL", "zsh": "SHELL",
    "wmic": "WMI", "wmic.exe": "WMI", "net": "NET_CMD", "net.exe": "NET_CMD", "net1": "NET_CMD", "net1.exe": "NET_CMD", "dsquery": "NET_CMD", "whoami": "IDENTITY_QUERY", "id": "IDENTITY_QUERY", "ipconfig": "NET_QUERY",
    "ifconfig": "NET_QUERY", "netstat": "NET_QUERY", "arp": "NET_QUERY", "nslookup": "NET_QUERY", "systeminfo": "SYS_QUERY", "hostname": "SYS_QUERY", "uname": "SYS_QUERY", "tasklist": "PROC_QUERY", "ps": "PROC_QUERY",
    "get-process": "PROC_QUERY", "dir": "FILE_ENUM", "ls": "FILE_ENUM", "find": "FILE_ENUM", "get-childitem": "FILE_ENUM", "mimikatz": "CRED_TOOL", "secretsdump": "CRED_TOOL", "procdump": "PROC_DUMP", "vssadmin": "SHADOW_MGMT",
    "wbadmin": "SHADOW_MGMT", "bcdedit": "BOOT_CONFIG", "chmod": "PERMISSION", "chown": "PERMISSION", "icacls": "PERMISSION", "cacls": "PERMISSION", "takeown": "PERMISSION", "attrib": "ATTRIB", "copy": "FILE_COPY",
    "xcopy": "FILE_COPY", "robocopy": "FILE_COPY", "cp": "FILE_COPY", "move": "FILE_MOVE", "mv": "FILE_MOVE", "del": "FILE_DELETE", "rm": "FILE_DELETE", "erase": "FILE_DELETE", "type": "FILE_READ", "cat": "FILE_READ",
    "more": "FILE_READ", "tar": "ARCHIVE", "zip": "ARCHIVE", "unzip": "ARCHIVE", "gzip": "ARCHIVE", "7z": "ARCHIVE", "compress-archive": "ARCHIVE", "expand-archive": "ARCHIVE", "rundll32": "PROXY_EXEC",
    "rundll32.exe": "PROXY_EXEC", "regsvr32": "PROXY_EXEC", "regsvr32.exe": "PROXY_EXEC", "mshta": "PROXY_EXEC", "mshta.exe": "PROXY_EXEC", "cscript": "SCRIPT_HOST", "wscript": "SCRIPT_HOST", "msiexec": "INSTALLER_EXEC",
    "msiexec.exe": "INSTALLER_EXEC",
}
VERB_TOKENS = {
    "reg add": "WRITE", "reg delete": "DELETE", "reg query": "QUERY", "reg export": "EXPORT", "reg import": "IMPORT", "reg save": "EXPORT", "reg load": "IMPORT", "reg copy": "COPY",
    "sc create": "CREATE", "sc config": "MODIFY", "sc delete": "DELETE", "sc query": "QUERY", "sc start": "START", "sc stop": "STOP",
    "net user": "USER_MGMT", "net group": "GROUP_QUERY", "net localgroup": "GROUP_QUERY", "net share": "SHARE_QUERY", "net view": "NET_ENUM", "net use": "NET_CONNECT", "net stop": "SVC_STOP", "net start": "SVC_START",
    "schtasks create": "CREATE", "schtasks delete": "DELETE", "schtasks query": "QUERY", "schtasks change": "MODIFY", "schtasks /create": "CREATE", "schtasks /delete": "DELETE", "schtasks /query": "QUERY", "schtasks /change": "MODIFY",
}
REGISTRY_BUCKETS = (
    ("AUTORUN", ("currentversion\\run", "currentversion\\winlogon", "session manager\\bootexecute", "environment\\userinitmprlogonscript", "currentversion\\policies\\explorer\\run")),
    ("SECURITY", ("defender", "firewall", "antivirus", "disableantispyware", "disablerealtimemonitoring", "tamperprotection", "securityhealth", "safeboot", "real-time protection", "spynet")),
    ("CREDENTIAL", ("sam", "security", "system", "ntds", "lsa", "credential", "wdigest", "tspkg", "livessp")), ("SERVICE_REG", ("services\\",)),
)
SUFFIX_TOKENS = {
    ".exe": "EXE_FILE", ".dll": "DLL_FILE", ".bat": "BAT_FILE", ".ps1": "PS1_FILE", ".vbs": "VBS_FILE", ".js": "JS_FILE", ".hta": "HTA_FILE", ".msi": "MSI_FILE", ".sys": "SYS_FILE", ".scr": "SCR_FILE", ".pif": "PIF_FILE",
    ".cmd": "CMD_FILE", ".lnk": "LNK_FILE", ".inf": "INF_FILE", ".py": "PY_FILE", ".sh": "SH_FILE", ".pl": "PL_FILE", ".zip": "ZIP_FILE", ".rar": "RAR_FILE", ".7z": "7Z_FILE", ".tar": "TAR_FILE", ".gz": "GZ_FILE",
    ".doc": "DOC_FILE", ".docx": "DOC_FILE", ".xls": "XLS_FILE", ".pdf": "PDF_FILE", ".sam": "CRED_FILE", ".dit": "CRED_FILE",
}
MASKS = (
    ("URL", r"(?i)https?://\S+|ftp://\S+"), ("UNC", r"\\\\[^\s\\]+(?:\\[^\s\\]+)*"),
    ("REGPATH", r"(?i)(?:HKLM|HKCU|HKEY_LOCAL_MACHINE|HKEY_CURRENT_USER|HKEY_CLASSES_ROOT|HKCR|HKU|HKEY_USERS)(?:\\[^\s\x22]+)+"),
    ("PATH", r"(?i)[A-Za-z]:\\(?:[^\s\\\x22]+\\)*[^\s\\\x22]*"), ("PATH", r"(?:/[\w.\-]+){2,}"), ("IP", r"\b\d{1,3}(?:\.\d{1,3}){3}\b"),
    ("DOMAIN", r"(?i)\b(?:[a-zA-Z0-9-]+\.)+(?:com|net|org|io|edu|gov|mil|info|biz|co|uk|de|ru|cn|xyz)\b"),
    ("GUID", r"\{?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\}?"), ("HEX", r"\b0x[0-9a-fA-F]{4,}\b"), ("B64", r"[A-Za-z0-9+/]{20,}={0,2}"), ("QUOTED", r"\x22[^\x22]{20,}\x22"), ("NUM", r"\b\d{3,}\b"),
)


def looked_up(table: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def action_tags() -> Column:
    """Sorted distinct action tags of a row."""
    rules = F.transform("fired_rules", lambda r: looked_up(RULE_ACTIONS, F.replace(r, F.lit("_rule_"), F.lit(""))))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(*[F.when(F.col(c), t) for c, t in ACTIONS]), rules))))


def stage(label: Column) -> Column:
    """The stage of a row whose gate label is given."""
    found = F.when(label == "Benign", "Benign Administration")
    for name, columns in STAGES:
        found = found.when(F.expr(" OR ".join(columns)), name)
    return found.when(F.col("rule_strength").isin("weak", "strong"), "Execution").otherwise("Context Required")


def weak_stage(technique: Column, tactic: Column) -> Column:
    """Stage of a row with feature_list and fired_rules: by technique, else its first RULE: tag, else its first rule, else its tactic."""
    first = lambda names: F.try_element_at(F.array_compact(F.transform(names, lambda n: looked_up(RULE_STAGE, n))), F.lit(1))
    named = F.transform(F.filter("feature_list", lambda f: f.startswith("RULE:")), lambda f: F.lower(F.substring(f, 6, 1 << 20)))
    bare = F.transform("fired_rules", lambda r: F.regexp_replace(F.replace(r, F.lit("_rule_"), F.lit("")), "^_+|_+$", ""))
    return F.coalesce(looked_up(TECHNIQUE_STAGE, technique), first(named), first(bare), looked_up(TACTIC_STAGE, tactic), F.lit("Context Required"))


def weak_actions() -> Column:
    """Sorted action tags that feature_list names."""
    named = F.transform("feature_list", lambda f: F.coalesce(looked_up(TAG_ACTION, f), F.when(f.startswith("RULE:"), looked_up(CLASS_ACTION, F.lower(F.substring(f, 6, 1 << 20))))))
    return F.array_sort(F.array_distinct(F.array_compact(named)))


def intent_bucket() -> Column:
    """high_signal, context_dependent or routine_candidate."""
    strength = F.col("rule_strength")
    return F.when(F.expr(" OR ".join(HIGH_SIGNAL)) | (strength == "strong"), "high_signal").when((strength == "weak") | F.expr(" OR ".join(IN_CONTEXT)), "context_dependent").otherwise("routine_candidate")


def registry_bucket(path: Column) -> Column:
    p = F.replace(F.lower(path), F.lit("/"), F.lit("\\"))
    found = None
    for name, parts in REGISTRY_BUCKETS:
        hit = F.exists(F.array(*map(F.lit, parts)), lambda x: F.contains(p, x))
        found = F.when(hit, name) if found is None else found.when(hit, name)
    com = F.contains(p, F.lit("classes\\")) & p.rlike("clsid|progid|shell")
    return found.when(com, "COM_HIJACK").when(F.contains(p, F.lit("policies\\")), "POLICY").otherwise("GENERAL")


def masked(text: Column) -> Column:
    """The text with places, addresses, long numbers and blobs as tags."""
    for name, pattern in MASKS:
        text = F.regexp_replace(text, pattern, f" <{name}> ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def residual_tokens() -> Column:
    """What a command does, as tokens: tool, verb, registry places, targets, kinds of files, structure, interpreters."""
    exe, sub = F.col("executable"), F.coalesce("subcommand", F.lit(""))
    some = lambda name, token: F.when(F.size(name) > 0, token)
    suffix = lambda p: looked_up(SUFFIX_TOKENS, F.regexp_extract(F.lower(p), r"(\.[a-z0-9]+)$", 1))
    return F.array_compact(F.concat(
        F.array(looked_up(TOOL_TOKENS, exe), F.coalesce(looked_up(VERB_TOKENS, F.concat_ws(" ", exe, sub)), F.when(~sub.isin("", "exe"), F.upper(sub)))),
        F.transform("registry_paths", lambda p: F.concat(F.lit("REG_"), registry_bucket(p))),
        F.array(F.when((F.size("remote_targets") > 0) | (F.size("urls") > 0), "REMOTE_TARGET"), some("ips", "IP_TARGET"), some("domains", "DOMAIN_TARGET")),
        F.array_distinct(F.transform("file_paths", suffix)),
        F.array(
            F.when(F.col("has_pipe"), "PIPED"), F.when(F.col("has_redirect"), "REDIRECT"), F.when(F.col("has_chain"), "CHAINED"), some("lolbin_matches", "LOLBIN"), some("encoded_markers", "ENCODED"), some("obfuscation_markers", "OBFUSCATED"),
            F.when(F.col("deobfuscated_command").isNotNull(), "DEOBFUSCATED"), F.when(F.col("inline_code"), "INLINE_EXEC"),
        ),
        F.transform("interpreter_markers", lambda m: F.concat(F.lit("INTERP_"), F.upper(m))),
    ))


def residual() -> Column:
    """Tokens of what a command does | its masked text."""
    parts = F.filter(F.array(F.array_join(residual_tokens(), " "), masked(F.coalesce("deobfuscated_command", "text"))), lambda x: x != "")
    return F.when(F.size(parts) == 0, "UNKNOWN_COMMAND").otherwise(F.array_join(parts, " | "))


def feature_list() -> Column:
    """Semantic tags and RULE: tags of the candidate classes."""
    return F.concat(semantic_tags(), F.transform("candidate_classes", lambda c: F.concat(F.lit("RULE:"), F.element_at(F.split(c, ":"), -1))))


def model_texts(command: str = "text") -> Column:
    """struct(input_a, input_b, input_c) of a row with residual and feature_list: raw text, residual and features; the last two; the residual."""
    features = F.when(F.size("feature_list") > 0, F.concat(F.lit("FEATURES: "), F.array_join("feature_list", " ")))
    rest = F.concat(F.lit("RESIDUAL: "), "residual")
    return F.struct(F.concat_ws("\n", F.concat(F.lit("RAW: "), command), rest, features).alias("input_a"), F.concat_ws("\n", rest, features).alias("input_b"), F.col("residual").alias("input_c"))


def family_scores(probabilities: Column, names: list[str], threshold: float) -> Column:
    """struct(selected, scores): families with their probability in percent; the selected ones by falling probability, then name."""
    all_of = F.transform(probabilities, lambda p, i: F.struct(F.element_at(F.array(*map(F.lit, names)), i + 1).alias("family"), F.round(p * 100, 2).alias("probability"), (p >= threshold).alias("selected")))
    order = F.array_sort(F.transform(F.filter(all_of, lambda s: s["selected"]), lambda s: F.struct((-s["probability"]).alias("r"), s["family"].alias("family"))))
    return F.struct(F.transform(order, lambda s: F.struct(s["family"].alias("family"), (-s["r"]).alias("probability"))).alias("selected"), all_of.alias("scores"))
