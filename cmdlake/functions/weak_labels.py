"""Weak labels of commands: a catalogue of patterns and the relabelling that uses it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cmdlake.functions.text import strip

# Patterns of commands that need context, in order; all without regard to case.
CONTEXT = {
    "identity_enum": r"^\s*(?:whoami|who|w|users|groups|last|lastlog|lastb|finger)\b|^\s*id(?:\s|$)|^\s*getent\s+(?:passwd|group|shadow)\b",
    "sysinfo": r"^\s*(?:hostname|uname|arch|nproc|lscpu|lshw|dmidecode)\b|^\s*lsb_release\b|^\s*free\s+(?:-[mhgtl])",
    "sensitive_file_read": r"(?:cat|head|tail|less|more|strings|xxd|od)\s+(?:[-\w]*\s+)*/(?:etc|proc)/",
    "security_logs": r"/var/log/(?:auth|secure|audit|btmp|wtmp|faillog|lastlog|messages|syslog|kern)",
    "file_inspect": r"(?:stat|file|md5sum|sha\d*sum)\s+/(?:etc|proc|bin|usr/bin|sbin)/",
    "wc_sensitive": r"\bwc\s+.*\s+/etc/",
    "ls_sensitive": r"\bls\s+(?:-\w+\s+)*/(?:etc|root|home|var/log)(?:/|\s|$)",
    "net_enum": r"^\s*(?:netstat|ifconfig|ss|arp|route|traceroute|tracepath|mtr)\b|^\s*ip\s+(?:addr|route|neigh|link|rule)\b",
    "ip_disclosure": r"(?:curl|wget)\s+.*(?:ifconfig\.me|icanhazip|ipinfo\.io|checkip|wtfismyip|ip\.me)",
    "proc_enum": r"^\s*(?:ps)\b|^\s*top\s+-b|^\s*(?:pgrep|pstree|pidof)\b",
    "lsof": r"^\s*lsof\b",
    "recon_tools": r"^\s*(?:nmap|masscan|zmap|nbtscan|enum4linux)\b",
    "packet_capture": r"^\s*(?:tcpdump|tshark|wireshark)\b",
    "debug_trace": r"^\s*(?:strace|ltrace)\b",
    "tunneling": r"ssh\s+.*-[DLR]\s|^\s*(?:nc|ncat)\s+.*-l|^\s*socat\b",
    "env_inspect": r"^\s*(?:env|printenv)\s*(?:$|\|)|^\s*set\s*$",
    "crontab_list": r"^\s*crontab\s+-l",
    "suid_discovery": r"find\s+/\s.*-perm\s+-[24]000|find\s+/\s.*-writable|getcap\s+-r\s+/",
    "find_root": r"^\s*find\s+/\s",
    "grep_sensitive": r"grep\s+.*(?:password|passwd|shadow|secret|token|credential|private.key|authorized_keys)",
    "dd_device": r"dd\s+.*(?:if=/dev/sd|of=/dev/sd|if=/dev/nvme|of=/dev/nvme|if=/dev/vd|of=/dev/vd)",
    "chmod_sus": r"chmod\s+(?:u\+s|g\+s|4[0-7]{3}|2[0-7]{3}|777|a\+rwx)\b",
    "mount_enum": r"^\s*(?:mount|lsblk|blkid|findmnt)\b|^\s*(?:fdisk|parted)\s+-l",
    "service_enum": r"systemctl\s+(?:status|list-units|list-unit-files|is-active|is-enabled)|^\s*service\s+--status-all",
    "nc_general": r"^\s*(?:nc|ncat)\b",
    "passwd_parse": r"(?:awk|cut|sed)\s+.*(?:/etc/passwd|/etc/group|/etc/shadow)",
    "sysctl": r"^\s*sysctl\s+",
    "proc_pid": r"(?:cat|head|tail|strings|ls)\s+/proc/\d+/",
    "history_cmd": r"^\s*history\b",
    "find_home": r"^\s*find\s+/home\b",
    "which_cmd": r"^\s*(?:which|whereis)\s+|^\s*command\s+-v\b|^\s*type\s+\w",
    "docker_enum": r"^\s*docker\s+(?:ps|images|inspect|network\s+ls|volume\s+ls|info|version)\b|^\s*docker\s+(?:logs|port|top|stats|diff)\b",
    "kubectl_enum": r"^\s*kubectl\s+(?:get|describe|auth|cluster-info|top|api-resources)\b",
    "file_syspath": r"^\s*file\s+/(?:bin|usr/bin|sbin|usr/sbin|lib|opt)/",
}
# What find_root leaves out, what wins as plain operation, what tells abuse, and techniques that need context.
FIND_CLEANUP = r"-delete|-exec\s+rm\b"
OPERATIONAL = (
    r"^\s*(?:pwd|date|uptime|whoami|id(?:\s|$)|hostname(?:\s|$)|uname(?:\s|$)|echo\b|printf\b|true\b|false\b|alias\b)|^\s*(?:df|free|lsblk|blkid|findmnt)\b|"
    r"^\s*cat\s+/(?:etc/(?:hostname|os-release|issue(?:\.net)?|debian_version|redhat-release)|proc/(?:version|cpuinfo|meminfo))\b|^\s*(?:git\s+log\b|docker\s+ps\b|systemctl\s+status\b|journalctl\s+-u\b)"
)
INDICATORS = (
    r"/dev/tcp/|mkfifo\s.*/tmp/|\bexec\s+\d+<>/dev/|curl\s.*\|\s*(?:ba)?sh|wget\s.*\|\s*(?:ba)?sh|curl\s.*-o\s.*/tmp/.*&&.*chmod|wget\s.*-O\s.*/tmp/.*&&.*chmod|base64\s+-d.*\|\s*(?:ba)?sh|eval\s.*\$\(|-enc\s+[A-Za-z0-9+/=]{20,}|"
    r"evil\.com|malware\.|attacker\.|c2\.|/etc/shadow|mimikatz|sekurlsa|hashdump|crontab.*\|.*(?:ba)?sh|/etc/sudoers|chmod\s+(?:u\+s|4[0-7]{3})\s+/(?:bin|usr/bin|sbin)/"
)
CONTEXT_TECHNIQUES = (
    "T1007", "T1010", "T1012", "T1016", "T1018", "T1033", "T1040", "T1046", "T1049", "T1057", "T1069", "T1082", "T1083", "T1087", "T1120", "T1135", "T1201", "T1217", "T1518", "T1526", "T1580", "T1613", "T1614", "T1615",
    "T1619", "T1622", "T1654", "T1005",
)


def predicates(command: Column) -> dict[str, Column]:
    """A boolean for every pattern, by name."""
    c = strip(command)
    found = {**CONTEXT, "find_cleanup": FIND_CLEANUP, "clear_operational": OPERATIONAL, "malicious_indicators": INDICATORS}
    return {name: c.rlike(f"(?i){pattern}") for name, pattern in found.items()}


def needs_context(p: dict[str, Column]) -> Column:
    """Whether a command taken for benign depends on its context; plain operation does not, unless it shows abuse."""
    any_ = p["find_root"] & ~p["find_cleanup"]
    for name in CONTEXT:
        any_ = any_ if name == "find_root" else any_ | p[name]
    return any_ & ~(p["clear_operational"] & ~p["malicious_indicators"])


def relabelled(command: Column, label: Column, technique: Column) -> Column:
    """Benign commands that need context, and malicious ones of a context technique without indicators, become Context_Dependent."""
    p = predicates(command)
    moved = (label == "Benign") & needs_context(p) | (label == "Malicious") & technique.isin(*CONTEXT_TECHNIQUES) & ~p["malicious_indicators"]
    return F.when(F.coalesce(moved, F.lit(False)), "Context_Dependent").otherwise(label)


def rule_baseline(command: Column) -> Column:
    """The label that the patterns alone give."""
    p = predicates(command)
    return F.when(p["malicious_indicators"], "Malicious").when(needs_context(p), "Context_Dependent").otherwise("Benign")
