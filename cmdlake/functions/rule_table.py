"""The rule families as data: a condition, priors, bans and evidence each, in SQL that engines share.

Conditions read the scalar columns of triage.rule_inputs and the features by name; lists are
there as text with chr(31) around every member.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Behaviour classes.
RUN_KEY, TASK, SERVICE = "persistence:registry_run_key", "persistence:scheduled_task", "persistence:create_modify_system_process"
SCRIPTING, WMI, PROXY = "execution:command_and_scripting_interpreter", "execution:windows_management_instrumentation", "defense_evasion:signed_binary_proxy_execution"
OBFUSCATED, DECODE = "defense_evasion:obfuscated_files_or_information", "defense_evasion:deobfuscate_decode_files"
INGRESS, ARCHIVE, EXFILTRATION = "command_and_control:ingress_tool_transfer", "collection:archive_collected_data", "exfiltration:exfiltration_over_c2_channel"
RECOVERY = "impact:inhibit_system_recovery"
ACCOUNTS, NETWORK, SYSTEMS = "discovery:account_discovery", "discovery:system_network_configuration_discovery", "discovery:remote_system_discovery"
REMOTE = "lateral_movement:remote_services"
REGISTRY, IMPAIR, PERMISSIONS = "defense_evasion:modify_registry", "defense_evasion:impair_defenses", "defense_evasion:file_permissions_modification"
REMOVAL, HIDE, MASQUERADE = "defense_evasion:indicator_removal", "defense_evasion:hide_artifacts", "defense_evasion:masquerading"
NATIVE = "execution:native_api"
FILES, QUERY, SYSTEM, PROCESSES = "discovery:file_and_directory_discovery", "discovery:query_registry", "discovery:system_information_discovery", "discovery:process_discovery"
CREDENTIALS = "credential_access:os_credential_dumping"
EVENT, BOOT, HIJACK, ACCOUNT_MGMT = "persistence:event_triggered_execution", "persistence:boot_logon_autostart_execution", "persistence:hijack_execution_flow", "persistence:account_manipulation"
ELEVATION = "privilege_escalation:abuse_elevation_control"
DESTRUCTION, LOCAL_DATA = "impact:data_destruction", "collection:data_from_local_system"

# Tool lists.
INTERPRETERS = (
    "powershell", "powershell.exe", "pwsh", "pwsh.exe", "cmd", "cmd.exe", "command.com", "bash", "sh", "zsh", "ksh", "csh", "tcsh", "dash", "fish", "python", "python3", "python2", "python.exe", "ruby", "perl", "lua",
    "node", "php", "osascript", "wscript", "cscript", "mshta", "mshta.exe",
)
BUILTINS = (
    "echo", "printf", "write-host", "write-output", "write-error", "write-verbose", "write-debug", "write-information", "invoke-expression", "iex", "invoke-command", "icm", "invoke-webrequest", "iwr",
    "invoke-restmethod", "irm", "start-process", "new-object", "set-variable", "if", "for", "while", "foreach", "switch", "try", "set", "export", "eval", "exec", "source", "alias",
)
PERMISSION_TOOLS = ("chmod", "chown", "chgrp", "icacls", "cacls", "takeown", "setfacl", "chattr")
PROXY_TOOLS = (
    "rundll32", "rundll32.exe", "regsvr32", "regsvr32.exe", "msiexec", "msiexec.exe", "certutil", "cmstp", "cmstp.exe", "installutil", "installutil.exe", "msbuild", "msbuild.exe", "xwizard", "xwizard.exe", "odbcconf",
    "odbcconf.exe", "forfiles", "forfiles.exe", "mavinject", "mavinject.exe", "ieexec", "infdefaultinstall", "control", "control.exe", "hh", "hh.exe", "pcalua", "pcalua.exe", "presentationhost", "presentationhost.exe",
    "syncappvpublishingserver", "syncappvpublishingserver.exe", "bitsadmin", "bitsadmin.exe",
)
FILE_TOOLS = ("dir", "ls", "find", "get-childitem", "gci", "tree", "locate", "fd", "where", "where.exe", "test-path")
SYSTEM_TOOLS = ("systeminfo", "systeminfo.exe", "uname", "ver", "hostname", "dmidecode", "lscpu", "lsb_release", "sw_vers", "lshw", "lspci", "lsusb", "lsmod", "get-computerinfo", "get-wmiobject")
PROCESS_TOOLS = ("ps", "tasklist", "tasklist.exe", "get-process", "top", "htop", "pgrep")
CREDENTIAL_TOOLS = ("mimikatz", "lazagne", "secretsdump", "pypykatz", "procdump", "procdump.exe", "gsecdump", "pwdump", "hashdump", "fgdump", "wce")
ELEVATION_TOOLS = ("sudo", "su", "doas", "runas", "pkexec", "pfexec", "gksudo", "kdesudo")
READERS = ("cat", "type", "more", "less", "head", "tail", "get-content", "gc", "strings", "xxd", "hexdump", "od")
ACCOUNT_TOOLS = ("useradd", "groupadd", "adduser", "addgroup", "usermod", "groupmod", "dsadd", "dsmod", "dscl", "new-aduser", "add-adgroupmember", "new-localuser")
LOLBIN_CANDIDATES = ("certutil", "mshta", "rundll32", "regsvr32", "wmic", "bitsadmin", "powershell", "powershell.exe", "cmd", "cmd.exe", "wscript", "cscript", "bash", "sh", "curl", "wget")
REGISTRY_QUERY = ("get-itemproperty", "get-item", "get-childitem")
REGISTRY_WRITE = ("set-itemproperty", "new-itemproperty", "remove-itemproperty", "set-item", "new-item", "remove-item")
SECURITY_SERVICES = ["windefend", "msmpsvc", "sense", "wuauserv", "wscsvc", "securityhealthservice", "mpssvc"]
CMDLETS = {
    "copy-item": LOCAL_DATA, "move-item": LOCAL_DATA, "get-content": LOCAL_DATA, "new-item": SCRIPTING, "remove-item": REMOVAL, "get-childitem": FILES, "start-process": SCRIPTING, "stop-process": IMPAIR,
    "get-process": PROCESSES, "invoke-webrequest": INGRESS, "invoke-restmethod": INGRESS, "invoke-expression": SCRIPTING, "invoke-command": SCRIPTING, "import-module": SCRIPTING, "write-host": SCRIPTING,
    "write-output": SCRIPTING, "write-error": SCRIPTING,
}
NET_VERBS = {
    "user": ACCOUNTS, "localgroup": ACCOUNTS, "group": ACCOUNTS, "view": SYSTEMS, "share": NETWORK, "use": REMOTE, "start": SERVICE, "stop": IMPAIR, "session": SYSTEMS, "accounts": ACCOUNTS, "config": NETWORK,
}


def q(text: str) -> str:
    """A SQL literal; backslashes by chr(92), which every engine reads alike."""
    return "(" + " || chr(92) || ".join("'" + x.replace("'", "' || chr(39) || '") + "'" for x in text.split("\\")) + ")"


def one_of(column: str, names: tuple[str, ...] | list[str]) -> str:
    return f"{column} IN ({', '.join(map(q, names))})"


def has(*parts: str, column: str = "norm") -> str:
    """Whether the column contains any of the parts."""
    return "(" + " OR ".join(f"contains({column}, {q(p)})" for p in parts) + ")"


def member(column: str, *values: str) -> str:
    return "(" + " OR ".join(f"contains({column}, chr(31) || {q(v)} || chr(31))" for v in values) + ")"


@dataclass(frozen=True)
class Rule:
    name: str
    strong: bool
    when: str
    #: (class, weight, further condition, whether it becomes a candidate)
    adds: list[tuple[str, float, str, bool]] = field(default_factory=list)
    #: (SQL text, further condition)
    says: list[tuple[str, str]] = field(default_factory=list)
    bans: tuple[str, ...] = ()
    #: When the rule counts as fired, if not whenever its condition holds.
    fires: str = ""


def simple(name: str, strong: bool, when: str, cls: str, weight: float, said: str) -> Rule:
    return Rule(name, strong, when, [(cls, weight, "true", True)], [(said, "true")])


def tool(name: str, note: str) -> str:
    return f"'{name}: ' || exe || ' — {note}'"


WRITES, DOWNLOADS = "writes_executable_like_file", "downloads_remote_resource"
_IS_QUERY0 = f"(({one_of('exe', ('reg', 'reg.exe'))} AND {one_of('sub', ('query', 'export', 'save'))}) OR {one_of('exe', REGISTRY_QUERY)})"
_IS_WRITE0 = f"(({one_of('exe', ('reg', 'reg.exe'))} AND {one_of('sub', ('add', 'delete', 'import', 'copy', 'load', 'unload'))}) OR {one_of('exe', REGISTRY_WRITE)})"
_TEXT_QUERY = has(" reg query ", "get-itemproperty", "get-childitem", " reg export ", " reg save ")
_TEXT_WRITE = has(" reg add ", " reg delete ", "set-itemproperty", "new-itemproperty", "remove-itemproperty", "new-item ", "set-item ", "remove-item ")
_NONE0 = f"NOT {_IS_QUERY0} AND NOT {_IS_WRITE0}"
_REG = f"(NOT modifies_registry_autorun AND (n_regs > 0 OR {has('hklm:', 'hkcu:', 'hkcr:', 'hku:', 'registry::')} OR {one_of('exe', ('reg', 'reg.exe', *REGISTRY_QUERY, *REGISTRY_WRITE))}))"
REG_QUERY = f"({_REG} AND ({_IS_QUERY0} OR ({_NONE0} AND {_TEXT_QUERY})))"
REG_WRITE = f"({_REG} AND ({_IS_WRITE0} OR ({_NONE0} AND NOT {_TEXT_QUERY} AND {_TEXT_WRITE})))"
SYSTEM_INFO = f"({one_of('exe', SYSTEM_TOOLS)} OR ({one_of('exe', ('cat', 'type', 'get-content'))} AND {has('/etc/os-release', '/proc/version', '/proc/cpuinfo', '/etc/hostname', '/etc/machine-id')}))"
PROCESS_INFO = f"({one_of('exe', PROCESS_TOOLS)} OR (exe = 'wmic' AND sub = 'process' AND NOT {has('call', 'create')}))"
_CHAINED = f"(has_pipe OR {has('/c ', '-c ', '&&', '; ')})"
_inside = lambda *tools: "(" + " OR ".join(f"(contains(norm, {q(t)}) AND exe <> {q(t.strip())})" for t in tools) + ")"
_NET_IN, _ID_IN, _SYS_IN, _PROC_IN, _REG_IN = (
    _inside("ipconfig", "ifconfig", "netstat", "route ", "arp ", "nslookup", "dig "), _inside("whoami", "net user"), _inside("systeminfo", "uname ", "hostname"), _inside("tasklist", "get-process", "wmic process"), _inside(" reg ", "regedit"),
)
_IMPAIRS = " OR ".join([
    one_of("exe", ("set-mppreference", "disable-windowsoptionalfeature", "remove-mppreference", "add-mppreference")), f"({one_of('exe', ('stop-service', 'disable-service'))} AND {has(*SECURITY_SERVICES)})",
    f"(exe = 'net' AND sub = 'stop' AND {has(*SECURITY_SERVICES)})", f"(exe = 'netsh' AND {has('firewall')})", f"(exe = 'ufw' AND {one_of('sub', ('disable', 'delete', 'reset'))})",
    f"(exe = 'iptables' AND {member('flags_s', '-f', '--flush', '-x', '-d')})", f"(exe = 'setenforce' AND {member('args_s', '0')})", one_of("exe", ("aa-disable", "aa-teardown")),
    f"(exe = 'systemctl' AND {one_of('sub', ('disable', 'stop'))} AND {has('apparmor', 'firewalld', 'ufw', 'selinux')})", f"(exe = 'auditpol' AND {has('set')})", f"(exe = 'wevtutil' AND {one_of('sub', ('cl', 'clear-log'))})",
])
_LOGS = ["/var/log/", "\\logs\\", ".log", "auth.log", "syslog", "security.evtx", "system.evtx", "application.evtx", "wtmp", "btmp", "lastlog", "utmp"]
_REMOVES = " OR ".join([
    f"(exe = 'touch' AND {member('flags_s', '-t', '-d', '-r')})", f"({one_of('exe', ('rm', 'del', 'erase', 'remove-item', 'shred', 'truncate'))} AND ({has(*_LOGS, column='paths_s')} OR {has(*_LOGS)} OR {has('.evtx', '.evt', column='paths_s')}))",
    f"({one_of('exe', ('clear-eventlog', 'wevtutil'))} AND ({one_of('sub', ('cl', 'clear-log'))} OR {has('clear')}))", has("histfile", "bash_history", ".zsh_history", "history -c"),
])
_HIDES = " OR ".join([
    f"({one_of('exe', ('attrib', 'attrib.exe'))} AND {has('+h')})", f"({one_of('exe', ('mkdir', 'touch', 'cp', 'mv', 'copy'))} AND {has('/.', chr(92) + '.')})", has(".txt:", ".exe:", ".dll:"), f"({has('hidden')} AND {one_of('exe', ('set-itemproperty', 'attrib', 'chflags'))})",
])
_AUTOSTART = has(".bashrc", ".bash_profile", ".profile", ".zshrc", ".cshrc", "/etc/profile", "/etc/profile.d/", "profile.d/", "/etc/rc.local", "rc.local", "/etc/init.d/", "init.d/", "start menu\\programs\\startup", "start menu/programs/startup", "\\appdata\\roaming\\microsoft\\windows\\start menu", "xdg/autostart")
_EVENTS = " OR ".join([
    one_of("exe", ("trap", "atbroker", "atbroker.exe")), f"({has('udev')} AND {has('rules.d', 'rule')})", has("narrator.exe", "osk.exe", "magnify.exe", "sethc.exe", "utilman.exe", "displayswitch.exe"), has("eventfilter", "eventconsumer", "__event"),
    f"({has('autostart')} AND {has('.desktop')})",
])
_HIJACKS = f"{has('ld_preload', 'ld_library_path', 'dyld_insert', 'dyld_framework', 'dyld_library', 'dll hijack', 'dllmain', 'sideload', 'search order')} OR ({one_of('exe', ('export', 'set', 'setx', 'setx.exe'))} AND {has('path')})"
_DESTROYS = f"{one_of('exe', ('shred', 'wipefs', 'srm', 'sdelete', 'sdelete.exe'))} OR (exe = 'dd' AND {has('if=/dev/zero', 'if=/dev/null', 'if=/dev/urandom')}) OR (exe = 'diskpart' AND {has('clean')}) OR (exe = 'rm' AND {has('-rf', column='flags_s')})"
_API = ["virtualalloc", "virtualprotect", "createremotethread", "ntcreatethreadex", "writeprocessmemory", "readprocessmemory", "openprocess", "createprocess", "shellexecute", "winexec", "loadlibrary", "getprocaddress", "dllimport", "p/invoke", "add-type", "interopservices", "reflection.assembly", "reflection.emit", "kernel32", "ntdll", "advapi32"]
_ELEVATES = f"{one_of('exe', ELEVATION_TOOLS)} OR (exe = 'find' AND {has('-perm')} AND {has('+4000', '+2000', '/4000', '/2000', '-4000', '-2000', 'u+s', 'g+s')}) OR (exe = 'start-process' AND {has('runas')})"
_KEYWORDS = [
    (["ld_preload", "ld_library", "dyld_"], HIJACK, 0.20), (["atbroker", "sethc", "utilman", "narrator.exe", "osk.exe", "magnify.exe"], EVENT, 0.20),
    (["lsass", "ntds.dit", "mimikatz", "hashdump", "credential"], CREDENTIALS, 0.20), (["defender", "antimalware", "antivirus", "security center"], IMPAIR, 0.20),
    (["autorun", "startup folder", "start menu"], BOOT, 0.20), (["suid", "setuid", "sgid", "setgid"], ELEVATION, 0.20), ([".dll", ".exe", ".sys", ".drv"], PROXY, 0.15),
    (["\\windows\\", "\\system32\\", "\\syswow64\\"], PROXY, 0.15), (["/usr/bin/", "/usr/sbin/", "/bin/", "/sbin/", "/opt/"], SCRIPTING, 0.15), (["hkcu\\", "hklm\\", "hkcr\\", "hku\\", "registry"], REGISTRY, 0.15),
]

RULES = [
    Rule("registry_persistence", True, "modifies_registry_autorun", [(RUN_KEY, 0.85, "true", True), (PROXY, 0.0, "true", True), (RUN_KEY, 0.10, WRITES, True)],
         [("'registry_autorun: write to autorun key [' || reg_s || ']'", "true"), ("'registry_autorun: payload is executable-like file'", WRITES)]),
    Rule("scheduled_task", True, "creates_scheduled_task", [(TASK, 0.85, "true", True), (PROXY, 0.0, "true", True), (TASK, 0.10, WRITES, True)],
         [("'scheduled_task: ' || exe || ' used to create/register a scheduled task'", "true"), ("'scheduled_task: task payload is executable-like'", WRITES)]),
    Rule("download_ingress", True, DOWNLOADS, [(INGRESS, 0.75, "true", True), (PROXY, 0.0, WRITES, True), (INGRESS, 0.10, WRITES, True), (PROXY, 0.40, "uses_signed_proxy_binary", True), (SCRIPTING, 0.50, "has_pipe AND runs_interpreter", True)],
         [("'ingress_transfer: remote resource fetched from ' || source", "true"), ("'ingress_transfer: downloaded payload is executable-like'", WRITES), ("'signed_proxy: ' || exe || ' is a signed proxy binary'", "uses_signed_proxy_binary"), ("'ingress_transfer: piped directly to interpreter (curl|bash pattern)'", "has_pipe AND runs_interpreter")]),
    Rule("archive_collection", False, "archive_create", [(ARCHIVE, 0.65, "true", True), (ARCHIVE, 0.10, "compression_or_archiving", True)], [("'archive_collection: ' || exe || ' used to create archive (possible staging/collection)'", "true")]),
    Rule("encoded_execution", True, "(uses_encoded_payload OR uses_obfuscation)",
         [(OBFUSCATED, 0.75, "true", True), (SCRIPTING, 0.60, "true", True), (PROXY, 0.50, "true", True), (SCRIPTING, 0.20, "executes_inline_code", True), (DECODE, 0.60, "decoded <> ''", True), (INGRESS, 0.55, DOWNLOADS, False)],
         [("'encoded_execution: encoded/obfuscated payload detected [' || enc_s || ']'", "true"), ("'encoded_execution: inline code execution via interpreter flag'", "executes_inline_code"), ("'encoded_execution: payload decoded to → ' || substr(decoded, 1, 120)", "decoded <> ''"), ("'encoded_execution: decoded payload downloads remote resource'", DOWNLOADS)]),
    Rule("wmi_remote_execution", True, "(exe = 'wmic' AND (sub = 'process' OR remote_execution_or_session))", [(WMI, 0.80, "true", True), (PROXY, 0.50, "true", True), (WMI, 0.15, has("create", column="args_s"), True)],
         [("'wmi_exec: wmic process call detected (remote/local execution via WMI)'", "true"), (f"{q('wmi_exec: ' + chr(39) + 'create' + chr(39) + ' keyword — spawning new process via WMI')}", has("create", column="args_s"))]),
    Rule("shadow_copy_deletion", True, "deletes_shadow_copies", [(RECOVERY, 0.90, "true", True)], [("'shadow_deletion: ' || exe || ' used to delete shadow copies (inhibit recovery)'", "true")], (INGRESS, RUN_KEY, TASK)),
    Rule("service_creation", True, "creates_or_modifies_service", [(SERVICE, 0.80, "true", True), (SERVICE, 0.10, WRITES, True)],
         [("'service_creation: ' || exe || ' ' || sub || ' — creates/modifies a system service'", "true"), ("'service_creation: service binPath points to executable-like file'", WRITES)]),
    Rule("remote_session", False, f"({one_of('exe', ('ssh', 'scp', 'sftp', 'rsync'))} AND (remote_execution_or_session OR transfers_file_to_remote))", [(REMOTE, 0.55, "true", True), (EXFILTRATION, 0.40, f"transfers_file_to_remote AND {WRITES}", True)],
         [("'remote_session: ' || exe || ' session/transfer to ' || first_remote", "true"), ("'remote_session: executable-like file transferred to remote host'", f"transfers_file_to_remote AND {WRITES}")]),
    Rule("discovery", False, "(enumerates_identity OR enumerates_network_config)", [(ACCOUNTS, 0.45, "enumerates_identity", True), (NETWORK, 0.45, "enumerates_network_config", True)],
         [(tool("discovery", "identity/account enumeration"), "enumerates_identity"), (tool("discovery", "network configuration discovery"), "enumerates_network_config")]),
    simple("interpreter_general", False, f"({one_of('exe', INTERPRETERS)} OR runs_interpreter OR executes_inline_code OR inline_code)", SCRIPTING, 0.25, tool("interpreter_general", "scripting/interpreter execution")),
    Rule("registry_broad", False, f"({REG_QUERY} OR {REG_WRITE})",
         [(QUERY, 0.28, REG_QUERY, True), (REGISTRY, 0.28, REG_WRITE, True), (IMPAIR, 0.35, f"{REG_WRITE} AND {has('defender', 'firewall', 'antivirus', 'spynet', 'disableantispyware', 'disablerealtimemonitoring', 'tamperprotection', 'securityhealth', 'safeboot', 'windows defender', 'real-time protection')}", True)],
         [("'registry_query: ' || exe || ' ' || sub || ' — registry enumeration/query'", REG_QUERY), ("'registry_write: ' || exe || ' ' || sub || ' — registry modification'", REG_WRITE),
          ("'registry_security_modification: registry write targets security settings'", f"{REG_WRITE} AND {has('defender', 'firewall', 'antivirus', 'spynet', 'disableantispyware', 'disablerealtimemonitoring', 'tamperprotection', 'securityhealth', 'safeboot', 'windows defender', 'real-time protection')}")]),
    simple("defense_impairment", True, f"({_IMPAIRS})", IMPAIR, 0.55, tool("defense_impairment", "security tool/policy manipulation")),
    simple("permission_modification", True, one_of("exe", PERMISSION_TOOLS), PERMISSIONS, 0.50, tool("permission_mod", "file/directory permission change")),
    simple("indicator_removal", True, f"({_REMOVES})", REMOVAL, 0.45, tool("indicator_removal", "log/evidence manipulation")),
    simple("hide_artifacts", False, f"({_HIDES})", HIDE, 0.40, tool("hide_artifacts", "hidden file/artifact manipulation")),
    simple("file_dir_discovery", False, f"({one_of('exe', FILE_TOOLS)} AND NOT (exe = 'find' AND {has('-perm')}))", FILES, 0.35, tool("file_discovery", "file/directory enumeration")),
    simple("system_info_discovery", False, SYSTEM_INFO, SYSTEM, 0.40, tool("system_info_discovery", "system information gathering")),
    simple("process_discovery", False, PROCESS_INFO, PROCESSES, 0.40, tool("process_discovery", "process enumeration")),
    simple("credential_access_broad", True, f"(reads_credential_store OR {one_of('exe', CREDENTIAL_TOOLS)})", CREDENTIALS, 0.55, tool("credential_access", "credential store access/dumping")),
    simple("privilege_escalation", False, f"({_ELEVATES})", ELEVATION, 0.40, tool("privilege_escalation", "elevation control abuse")),
    Rule("lolbin_proxy_broad", False, f"({one_of('exe', PROXY_TOOLS)} OR n_lolbins > 0)", [(PROXY, 0.35, "true", True), (INGRESS, 0.25, one_of("exe", ("certutil", "bitsadmin", "bitsadmin.exe")), True)], [(tool("lolbin_proxy", "signed binary proxy / LOLBin execution"), "true")]),
    simple("event_triggered", False, f"({_EVENTS})", EVENT, 0.40, tool("event_triggered", "event-triggered execution")),
    simple("boot_logon_broad", False, f"(({_AUTOSTART} AND NOT {one_of('exe', ('echo', 'printf', 'cat', 'type', 'write-host', 'write-output', 'write-error', 'write-verbose'))}) OR (exe = 'systemctl' AND sub = 'enable'))", BOOT, 0.35, "'boot_logon: autostart/login script path detected'"),
    simple("hijack_execution", False, f"({_HIJACKS})", HIJACK, 0.35, "'hijack_execution: execution flow hijacking pattern'"),
    simple("data_from_local", False, f"({one_of('exe', READERS)} AND (n_paths > 0 OR {one_of('exe', ('strings', 'xxd', 'hexdump', 'od'))}))", LOCAL_DATA, 0.25, tool("data_from_local", "reading local file data")),
    simple("data_destruction", True, f"({_DESTROYS})", DESTRUCTION, 0.35, tool("data_destruction", "destructive operation")),
    simple("account_management", True, f"({one_of('exe', ACCOUNT_TOOLS)} OR (exe = 'net' AND {one_of('sub', ('user', 'localgroup', 'group'))} AND ({has('/add')} OR {member('args_s', 'add')})))", ACCOUNT_MGMT, 0.45, tool("account_mgmt", "account/group manipulation")),
    simple("masquerading_heuristic", False, f"({one_of('exe', ('copy', 'cp', 'move', 'mv', 'copy-item', 'move-item', 'xcopy', 'robocopy', 'ren', 'rename', 'rename-item'))} AND {has(chr(92) + 'windows' + chr(92) + 'system32', chr(92) + 'windows' + chr(92) + 'syswow64', chr(92) + 'system32' + chr(92), chr(92) + 'syswow64' + chr(92), '/usr/bin/', '/usr/sbin/', '/usr/local/bin/')})", MASQUERADE, 0.30, tool("masquerading", "file placed in/moved to system path")),
    simple("native_api_heuristic", False, has(*_API), NATIVE, 0.30, "'native_api: API call / P/Invoke pattern detected'"),
    Rule("command_content_scan", False, f"({_CHAINED} AND ({_NET_IN} OR {_ID_IN} OR {_SYS_IN} OR {_PROC_IN} OR {_REG_IN}))",
         [(NETWORK, 0.25, _NET_IN, True), (ACCOUNTS, 0.25, _ID_IN, True), (SYSTEM, 0.25, _SYS_IN, True), (PROCESSES, 0.25, _PROC_IN, True), (REGISTRY, 0.20, _REG_IN, True)],
         [("'content_scan: chained command contains a network tool'", _NET_IN)], (),
         f"({_CHAINED} AND ({_NET_IN} OR ({_ID_IN} AND NOT enumerates_identity) OR ({_SYS_IN} AND NOT {SYSTEM_INFO}) OR ({_PROC_IN} AND NOT {PROCESS_INFO}) OR ({_REG_IN} AND NOT {REG_WRITE})))"),
    Rule("powershell_cmdlets", False, one_of("exe", list(CMDLETS)), [(c, 0.25, f"exe = '{n}'", True) for n, c in CMDLETS.items()], [(f"'ps_cmdlet: ' || exe || ' → {c}'", f"exe = '{n}'") for n, c in CMDLETS.items()]),
    Rule("file_operations", False, one_of("exe", ("copy", "cp", "xcopy", "robocopy", "move", "mv", "ren", "rename", "rm", "del", "erase", "shred", "unlink", "mkdir", "md")),
         [(LOCAL_DATA, 0.20, one_of("exe", ("copy", "cp", "xcopy", "robocopy", "move", "mv", "ren", "rename")), True), (REMOVAL, 0.20, one_of("exe", ("rm", "del", "erase", "shred", "unlink")), True), (SCRIPTING, 0.15, one_of("exe", ("mkdir", "md")), True)],
         [(tool("file_op", "file copy/move operation"), one_of("exe", ("copy", "cp", "xcopy", "robocopy", "move", "mv", "ren", "rename"))), (tool("file_op", "file deletion"), one_of("exe", ("rm", "del", "erase", "shred", "unlink"))), (tool("file_op", "directory creation"), one_of("exe", ("mkdir", "md")))]),
    Rule("net_command", False, "exe = 'net'", [*[(c, 0.35, f"sub = '{n}'", True) for n, c in NET_VERBS.items()], (SCRIPTING, 0.15, f"NOT {one_of('sub', list(NET_VERBS))}", True)],
         [*[(f"'net_command: net {n} → {c}'", f"sub = '{n}'") for n, c in NET_VERBS.items()], ("'net_command: net ' || sub || ' — generic'", f"NOT {one_of('sub', list(NET_VERBS))}")]),
    simple("scripting_builtins", False, one_of("exe", BUILTINS), SCRIPTING, 0.15, tool("scripting_builtin", "shell/script builtin")),
    # last, and only where no prior is above a half yet
    Rule("keyword_heuristic", False, f"(length(norm) >= 3 AND ({' OR '.join(has(*words) for words, _, _ in _KEYWORDS)}))", [(c, w, has(*words), True) for words, c, w in _KEYWORDS], [(f"'keyword_heuristic: matched {c} via keyword'", has(*words)) for words, c, _ in _KEYWORDS]),
]


def _when(rule: Rule) -> str:
    return rule.when


def effects(rules: list[Rule], when=_when) -> list[tuple[str, bool, str, str, float, bool]]:
    """(rule, strong, condition, class, weight, candidate) of each prior; ``when`` gives the text of a rule's own condition."""
    return [(r.name, r.strong, f"{when(r)} AND {also}", c, w, k) for r in rules for c, w, also, k in r.adds]


def fired(rules: list[Rule], when=_when) -> list[tuple[str, bool, str]]:
    return [(r.name, r.strong, r.fires or when(r)) for r in rules]


def evidence(rules: list[Rule], when=_when) -> list[tuple[str, str]]:
    return [(f"{when(r)} AND {also}", text) for r in rules for text, also in r.says]


def bans(when=_when) -> list[tuple[str, str]]:
    return [(when(r), c) for r in RULES for c in r.bans]
