"""A command line as one struct column: operators, tokens, flags, targets and markers.

Only a command with a quote and no sign of Windows needs POSIX quoting; those rows alone go
through an Arrow function, the rest stays in native expressions.
"""

from __future__ import annotations

import re
import shlex

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cmdlake.functions.text import collapse

# Fixed values.
URL = r"(?i)\b(?:https?|ftp)://[^\s\"'<>|]+"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
PORT = r":(\d{1,5})(?:\b|/)"
REGISTRY = r"(?i)\b(?:HKLM|HKCU|HKCR|HKU|HKCC)\\[^\s\"']+"
TOKEN = r"\"[^\"]*\"|\S+"
WINDOWS_WORD = r"(?i)\b(reg|schtasks|wmic|cmd|powershell)\b"
REDIRECT = r"2>>|2>|1>>|1>|>>|<<|>|<"
CHAIN = r"&&|\|\||;"
OPERATORS = ("|", ">", ">>", "<", "<<", "2>", "2>>", "1>", "1>>", "&&", "||", ";")
ENCODED = (
    (r"(?i)(?:^|\s)-enc(?:odedcommand)?(?:\s|$)", "encoded_command_flag"),
    (r"(?i)frombase64|string", "base64_string_decode"),
    (r"\b[A-Za-z0-9+/]{20,}={0,2}\b", "base64_blob"),
    (r"\\x[0-9a-fA-F]{2}", "hex_escape"),
)
OBFUSCATED = (
    (r"(?i)\[char\]", "char_cast"),
    (r"(?i)frombase64", "base64_decode_api"),
    (r"(?i)encodedcommand|-enc\b", "encoded_command"),
    (r"(?i)\b(?:\$\w{8,}|%[A-Za-z0-9_]+%)\b", "variable_indirection"),
    (r"\\x[0-9a-fA-F]{2}", "hex_escape"),
)
INLINE_FLAGS = ("-c", "/c", "-e", "-enc", "-encodedcommand")
FILE_SUFFIX = r"(?i)\.(exe|dll|hta|ps1|bat|cmd|sh|py|zip|tar|gz|tgz|7z|rar|log|txt|csv|json|yaml|yml|conf|cfg|bak|pdf)$"


def all_of(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def posix_tokens(commands: pd.Series) -> pd.Series:
    def split(text: str | None) -> list[str] | None:
        if text is None:
            return None
        try:
            return shlex.split(text, posix=True)
        except ValueError:
            return re.findall(TOKEN, text)

    return commands.map(split)


def tokens(c: Column, quotes: bool = True) -> Column:
    """Tokens of a collapsed command; quotes=False where no command holds quotes keeps the plan native."""
    plain = all_of(c, TOKEN)
    if not quotes:
        return plain
    posix = c.rlike("['\"]") & ~c.contains("\\") & ~c.rlike(WINDOWS_WORD)
    return F.when(posix, F.pandas_udf(posix_tokens, "array<string>")(F.when(posix, c))).otherwise(plain)


def is_flag(t: Column) -> Column:
    windows = t.rlike("^/[^/]") & (~F.substring(t, 2, 1 << 20).contains("/") | t.rlike("^/[A-Za-z0-9_-]+$"))
    return t.startswith("--") | t.rlike("^-.") | windows


def is_file(t: Column) -> Column:
    return (
        t.rlike(r"^[A-Za-z]:\\") | t.rlike(r"^\.{1,2}\\") | t.isin(".", "..", "~") | t.rlike(r"^(/|\./|\.\./|~/)") | is_remote(t) | t.rlike(FILE_SUFFIX)
    )


def is_remote(t: Column) -> Column:
    return t.contains("@") | t.startswith("\\\\")


def valid_ips(c: Column) -> Column:
    """Distinct dotted quads with octets to 255 and no leading zeros."""
    octets = lambda ip: F.forall(F.split(ip, r"\."), lambda o: (o.cast("int") <= 255) & ((o == "0") | ~o.startswith("0")))
    return F.array_distinct(F.filter(all_of(c, IPV4), octets))


def ports(c: Column) -> Column:
    found = F.transform(all_of(c, PORT, 1), lambda p: p.cast("int"))
    return F.array_distinct(F.transform(F.filter(found, lambda p: (p > 0) & (p <= 65535)), lambda p: p.cast("string")))


def marks(c: Column, labelled: tuple) -> Column:
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(name)) for p, name in labelled]))


def parse(command: Column, quotes: bool = True) -> Column:
    """The struct of a raw command."""
    text = collapse(command)
    words = tokens(text, quotes)
    real = F.filter(words, lambda t: ~t.isin(*OPERATORS))
    exe = F.lower(F.element_at(F.split(F.regexp_replace(F.try_element_at(real, F.lit(1)), r"\\", "/"), "/"), -1))
    rest = F.slice(real, 2, 1 << 20)
    return F.struct(
        text.alias("text"),
        exe.alias("executable"),
        F.array_distinct(F.filter(rest, is_flag)).alias("flags"),
        F.array_distinct(F.filter(rest, lambda t: ~is_flag(t))).alias("positional_args"),
        F.filter(all_of(text, r"\|+"), lambda x: x == "|").alias("pipe_operators"),
        all_of(text, REDIRECT).alias("redirect_operators"),
        all_of(text, CHAIN).alias("chain_operators"),
        F.array_distinct(all_of(text, URL)).alias("urls"),
        valid_ips(text).alias("ips"),
        ports(text).alias("ports"),
        F.array_distinct(all_of(text, REGISTRY)).alias("registry_paths"),
        F.array_distinct(F.filter(rest, is_file)).alias("file_paths"),
        F.array_distinct(F.filter(rest, is_remote)).alias("remote_tokens"),
        marks(text, ENCODED).alias("encoded_markers"),
        marks(text, OBFUSCATED).alias("obfuscation_markers"),
        F.arrays_overlap(F.transform(F.filter(rest, is_flag), F.lower), F.array(*map(F.lit, INLINE_FLAGS))).alias("inline_code"),
    )


# Fixed values.
INTERPRETERS = {
    "bash": "bash", "sh": "sh", "zsh": "zsh", "fish": "fish", "python": "python", "python3": "python", "py": "python", "perl": "perl", "ruby": "ruby", "php": "php",
    "node": "node", "node.exe": "node", "powershell": "powershell", "powershell.exe": "powershell", "pwsh": "powershell", "cmd": "cmd", "cmd.exe": "cmd",
    "wscript": "wscript", "cscript": "cscript",
}
WINDOWS_TOOLS = (
    "powershell", "pwsh", "cmd", "reg", "schtasks", "wmic", "certutil", "mshta", "rundll32", "vssadmin", "bitsadmin", "ipconfig", "net", "sc", "wscript", "cscript",
)
LINUX_TOOLS = (
    "ls", "pwd", "cat", "curl", "wget", "tar", "unzip", "ssh", "scp", "rsync", "docker", "systemctl", "find", "grep", "awk", "sed", "bash", "sh", "python3", "python",
    "zip", "gunicorn", "flask", "node", "id", "uname", "ifconfig", "ip", "netstat", "ss", "dig", "nslookup", "traceroute", "ping",
)
PROXY_WINDOWS = ("certutil", "mshta", "rundll32", "regsvr32", "wmic", "powershell", "bitsadmin", "schtasks", "vssadmin", "reg", "cmd", "wscript", "cscript")
PROXY_LINUX = ("bash", "sh", "curl", "wget", "ssh", "scp", "tar", "find", "python", "python3", "perl", "ruby", "php", "awk", "sed")
ARCHIVERS = ("tar", "zip", "unzip", "7z", "7za", "gzip", "gunzip", "rar", "unrar")
ARCHIVE_SUFFIX = r"(?i)\.(zip|tar|gz|tgz|bz2|xz|7z|rar)$"


def bare_tool(exe: Column) -> Column:
    return F.regexp_replace(exe, r"\.exe$", "")


def interpreter_markers(command: Column) -> Column:
    """Interpreters among the tokens that are no flags, in order."""
    known = F.create_map(*[F.lit(x) for kv in INTERPRETERS.items() for x in kv])
    base = lambda t: F.lower(F.element_at(F.split(F.regexp_replace(t, r"\\", "/"), "/"), -1))
    named = F.transform(F.filter(all_of(collapse(command), TOKEN), lambda t: ~is_flag(t) | t.startswith("/")), lambda t: F.try_element_at(known, base(t)))
    return F.array_distinct(F.array_compact(named))


def refanged_urls(c: Column) -> Column:
    """Distinct hxxp(s) URLs in plain form."""
    found = all_of(c, r"(?i)\bhxxps?://[^\s\"'<>|]+")
    plain = F.transform(found, lambda u: F.regexp_replace(F.regexp_replace(F.regexp_replace(u, r"(?i)^hxxp", "http"), r"\[\.\]", "."), r"[.,;:)\]]+$", ""))
    return F.array_distinct(plain)
