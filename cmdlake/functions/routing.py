"""Routing features of command views: a catalogue of patterns, and the decision they override."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdlake.functions import decoding

# Pattern by feature, matched without case; ANY_LINE patterns also at line starts.
PATTERNS = {
    "has_download": r"\b(?:curl|wget|invoke-webrequest|iwr|bitsadmin|certutil(?:\.exe)?|aria2c|fetch)\b",
    "has_pipe_to_shell": r"(?s)(?:curl|wget|invoke-webrequest|iwr|echo|printf).{0,200}\|\s*(?:(?:/bin/)?(?:ba|z)?sh|pwsh?|powershell)\b",
    "has_reverse_shell_pattern": r"(?s)(?:/dev/tcp/|\bnc(?:at)?\b.*(?:-e|-c)\s*/bin/(?:ba)?sh\b|mkfifo\b.*\bnc(?:at)?\b|socket\.socket\(\).*connect\(|tcpsocket\.open\(|fsockopen\(|s_client\b.*\|\s*/bin/(?:ba)?sh\b)",
    "has_base64_or_encoded_exec": r"(?:-enc(?:odedcommand)?\s+[A-Za-z0-9+/=]{20,}|frombase64string|base64\s+-d\b|certutil\s+-decode\b)",
    "has_eval_exec": r"\b(?:eval|iex\b|invoke-expression\b|exec\s*\(|python\d?\s+-c\b|perl\s+-e\b|ruby\s+-e\b|php\s+-r\b|node\s+-e\b)",
    "has_shell_spawn": r"(?:/bin/(?:ba)?sh\b|cmd(?:\.exe)?\s+/c\b|powershell(?:\.exe)?\b|pwsh\b)",
    "has_sensitive_file_read": r"\b(?:cat|less|more|head|tail|grep|awk|sed|cut|strings|xxd|od|nl|wc|stat|file)\b.*(?:/etc/(?:shadow|sudoers)|/root/\.ssh/|authorized_keys|id_rsa|\.kube/config|/proc/\d+/environ)",
    "has_network_enum": r"^\s*(?:nmap|masscan|zmap|netstat|ss|ifconfig|arp|route|traceroute|tracepath|mtr|dig|nslookup|host)\b|^\s*ip\s+(?:addr|route|neigh|link|rule)\b",
    "has_process_enum": r"^\s*(?:ps|top|pstree|pgrep|pidof|lsof)\b|^\s*docker\s+(?:ps|top|inspect)\b",
    "has_tunneling": r"\bssh\b.*\s-[DLR]\s|\bchisel\b|\bsocat\b|\bsshuttle\b|\bfrp[cps]\b|\bnc(?:at)?\b.*\s-l\b",
    "has_packet_capture": r"^\s*(?:tcpdump|tshark|dumpcap|wireshark)\b",
    "has_debug_trace": r"^\s*(?:strace|ltrace|gdb|perf\s+trace)\b",
    "has_offensive_tooling": r"^\s*(?:nmap|nikto|hydra|sqlmap|masscan|zmap|enum4linux|crackmapexec|responder|impacket-|msfconsole|mimikatz(?:\.exe)?|john\b|hashcat\b|linpeas(?:\.sh)?|pspy\d*|bloodhound-python)\b",
    "has_persistence_change": r"(?:crontab\s+-(?!l\b)|echo\s+.*\|\s*crontab\b|schtasks\s+/create\b|currentversion\\run\b|authorized_keys\b.*>>|systemctl\s+enable\b|rc\.local|(?:cp|mv|install|tee)\b.*\b/etc/cron\.(?:d|daily|hourly|monthly|weekly)\b|(?:echo|printf)\b.*>\s*/etc/cron\.(?:d|daily|hourly|monthly|weekly)\b|at\s+\d)",
    "has_privilege_escalation": r"(?:chmod\s+(?:u\+s|4[0-7]{3})\s+/(?:bin|usr/bin|sbin)|/etc/sudoers\b.*>|useradd\s+.*-u\s+0\b|setcap\s+cap_setuid|usermod\b.*-aG\s+(?:sudo|wheel|root|admin|docker)\b|passwd\s+-d\s+root\b|PermitRootLogin\s+yes.*>>\s*/etc/ssh)",
    "has_defense_impairment": r"(?:iptables\s+-F\b|ufw\s+disable\b|setenforce\s+0\b|systemctl\s+(?:stop|disable)\s+(?:firewalld|ufw|auditd|sysmon)|auditctl\b.*-e\s+0|sc\s+stop\s+windefend|powershell.*set-mppreference|truncate\s+-s\s+0\s+/var/log|shred\b.*(?:/var/log|/etc/|auth\.log|syslog|kern\.log))",
    "has_destructive_write": r"(?:\bdd\b.*(?:if=/dev/(?:zero|urandom)).*(?:of=/dev/(?:sd[a-z]\d*|nvme\d+n\d+(?:p\d+)?|vd[a-z]\d*))|\bmkfs(?:\.[a-z0-9_+-]+)?\b\s+/dev/|\brm\s+-rf\s+/+(?:\s|$)|shred\b.*\s+/dev/|\bwipefs\s+-a\b|\buserdel\s+-r\b|\bpkill\s+-9\s+(?:sshd|init|systemd)\b|\bkill\s+-9\s+1\b)",
    "has_archive_or_bulk_copy": r"^\s*(?:tar|zip|7z|rar|rsync)\b.*(?:/etc|/var/log|/home|/opt|/srv)|^\s*cp\b.*(?:/etc(?:/|\s)|/var/log).*(?:/etc|/var/log|/home|/opt|/srv)|^\s*find\b(?!.*-maxdepth\s+[12]\b).*(?:/etc|/var/log|/home).*(?:-name|-type)",
    "has_remote_transfer": r"^\s*(?:scp|sftp|ftp|rsync)\b.*[@:][^ ]+|^\s*(?:curl|wget)\b.*(?:--upload-file|-T|--data-binary\s+@|--form\s+@|-d\s+@)",
    "has_credential_dumping_pattern": r"(?:/etc/shadow\b|mimikatz|sekurlsa|hashdump|lsass|sam hive|unshadow\b|john\b.*rockyou|secretsdump)",
    "has_exploit_or_attack_tooling": r"^\s*(?:hydra|sqlmap|nikto|msfconsole|mimikatz(?:\.exe)?|john\b|hashcat\b|responder\b|ettercap\b|arpspoof\b|crackmapexec\b|impacket-|metasploit\b|secretsdump\b|mshta\b)",
    "has_enumeration_recon": r"(?m)(?:^\s*(?:ss|netstat)\s+-[a-zA-Z]*(?:a|p)[a-zA-Z]*\b|^\s*(?:last(?:\s+-\d+)?|w|who)\s*$|^\s*(?:ls|cat|find|stat)\b.*/etc/cron|^\s*ps\s+aux(?:ww)?\s*$|^\s*ls\b.*(?:/dev/shm|/root)\b|^\s*env\s*\|\s*grep\s+-i\s*(?:secret|token|key|password|cred)|^\s*(?:iptables\s+-L|aa-status|sestatus|apparmor_status)\b|^\s*sudo\s+-l\b|^\s*(?:systemd-detect-virt|dmidecode)\b|\bdmesg\b.*\bgrep\b.*\b(?:virtual|vbox|vmware|hyperv|qemu|kvm)\b|^\s*ip\s+route\s*$|^\s*python3?\s+-m\s+http\.server\s+(?!127\.0\.0\.1)\d|^\s*cat\s+/proc/version\b|^\s*getfacl\b.*(?:/etc/shadow|/etc/sudoers)|^\s*lsmod\b.*\|\s*grep\b.*\b(?:vbox|vmware|hyperv)\b)",
    "has_exfil_data_movement": r"(?m)(?:^\s*curl\b.*(?:-X\s+POST|--request\s+POST)\b.*-d\s+@|^\s*tar\b.*(?:/home/[^\s]+/\.ssh|/root/\.ssh|/etc/shadow)|^\s*(?:scp|rsync)\b.*(?:/etc/passwd|/etc/shadow).*@|^\s*(?:curl|wget)\b.*https?://(?:10\.|172\.(?:1[6-9]|2\d|3[01])\.|192\.168\.)\S+)",
}
#: The same for engines without look-ahead, over commands that hold neither find -maxdepth nor a local http.server.
WITHOUT_LOOKAHEAD = {
    "has_persistence_change": (r"crontab\s+-(?!l\b)", r"crontab\s+-(?:[^l]|l\w|$)"),
    "has_archive_or_bulk_copy": (r"(?!.*-maxdepth\s+[12]\b)", ""),
    "has_enumeration_recon": (r"(?!127\.0\.0\.1)", ""),
}
SUSPICIOUS = (
    "has_reverse_shell_pattern", "has_offensive_tooling", "has_destructive_write", "has_exploit_or_attack_tooling", "has_pipe_to_shell", "has_base64_or_encoded_exec", "has_eval_exec", "has_shell_spawn", "has_sensitive_file_read", "has_tunneling", "has_persistence_change",
    "has_privilege_escalation", "has_defense_impairment", "has_credential_dumping_pattern", "has_exfil_data_movement", "has_remote_transfer",
)


def routing_features(*views: Column) -> Column:
    """One boolean per feature: whether any view (raw, decoded) matches it."""
    texts = [F.lower(F.regexp_replace(F.coalesce(v, F.lit("")), r"^\s+|\s+$", "")) for v in views]

    def any_of(pattern: str) -> Column:
        found = texts[0].rlike("(?i)" + pattern)
        for t in texts[1:]:
            found = found | t.rlike("(?i)" + pattern)
        return found

    return F.struct(*[any_of(p).alias(name) for name, p in PATTERNS.items()])


def with_features(df: DataFrame, column: str = "command", name: str = "f") -> DataFrame:
    """df with the features of each command and of its decoded form; only what may be obfuscated is decoded and matched twice."""
    c = F.col(column)
    odd = decoding.worth_a_look(c)
    (hidden,) = [n for n in ("decoded", "decoded_") if n not in df.columns][:1]
    plain = df.filter(~odd).withColumn(name, routing_features(c))
    found = decoding.decode(df.filter(odd), column, hidden)
    return plain.unionByName(found.withColumn(name, routing_features(c, F.col(f"{hidden}.final"))).drop(hidden))


def suspicious_features(features: Column) -> Column:
    """Names of the matched features that force a closer look, in catalogue order."""
    return F.array_compact(F.array(*[F.when(features[name], F.lit(name)) for name in PATTERNS if name in SUSPICIOUS]))


def route(benign: Column, suspicious: Column) -> Column:
    """struct(label, confidence): a suspicious feature overrides the model at a confidence of .90 or more."""
    p = 1 - benign
    forced = F.size(suspicious) > 0
    return F.struct(
        F.when(forced | (benign < 0.5), "Suspicious").otherwise("Benign").alias("label"),
        F.when(forced, F.greatest(p, F.lit(0.9))).otherwise(F.greatest(p, benign)).alias("confidence"),
    )
