"""Column functions over command text: keys, normal forms, redaction, indicators, entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Redaction patterns in their order, with replacements.
CREDENTIAL_URL = (r"(https?://)([^\s:/@]+):([^\s@]+)@", "$1<redacted-user>:<redacted-secret>@")
ASSIGNMENT = (
    r"(?i)\b((?:api|access|auth|bearer|db|deploy|github|gitlab|jwt|passwd|password|secret|session|token|webhook)[A-Za-z0-9_\-]*)=([^\s'\"]+)\b",
    "$1=<redacted-secret>",
)
SECRET_FLAG = (r"(?i)(--?(?:token|password|passwd|secret|api[-_]?key|access[-_]?key|client[-_]?secret))\s+([^\s]+)", "$1 <redacted-secret>")
BEARER = (r"(?i)(Authorization:\s*Bearer\s+)([^\s'\"]+)", "$1<redacted-secret>")
TOKEN_SHAPE = (
    r"\b(?:ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z\-_]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_\-.]{20,})\b",
    "<redacted-secret>",
)
PRIVATE_IP = (
    r"\b(?:10(?:\.\d{1,3}){3}|127(?:\.\d{1,3}){3}|192\.168(?:\.\d{1,3}){2}|172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2})\b",
    "<redacted-private-ip>",
)
INTERNAL_DOMAIN = (r"(?i)\b(?:[A-Za-z0-9-]+\.)+(?:corp|internal|local|lan|home|cluster|svc)\b", "<redacted-internal-domain>")
HOME_USER = (r"(/home/)([^/\s]+)", "$1<redacted-user>")
SSH_TARGET = (r"\b([A-Za-z0-9._-]+)@([A-Za-z0-9._-]+)\b", "<redacted-user>@<redacted-host>")
ALWAYS = (CREDENTIAL_URL, ASSIGNMENT, SECRET_FLAG, BEARER, TOKEN_SHAPE)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def match_key(c: Column) -> Column:
    """Lower case without outer white space."""
    return F.lower(strip(c))


def collapse(c: Column) -> Column:
    """Outer white space off, inner runs to one space."""
    return F.regexp_replace(strip(c), r"\s+", " ")


def dedup_key(c: Column) -> Column:
    return F.lower(collapse(c))


def command_id(c: Column) -> Column:
    return F.sha2(c, 256)


def redactions(ips: bool = True, domains: bool = True, users: bool = True) -> list[tuple[str, str]]:
    return [*ALWAYS, *[PRIVATE_IP] * ips, *[INTERNAL_DOMAIN] * domains, *[HOME_USER, SSH_TARGET] * users]


def redact(c: Column, ips: bool = True, domains: bool = True, users: bool = True) -> Column:
    """Secrets, and by switch private addresses, internal names and user names, written over."""
    for pattern, new in redactions(ips, domains, users):
        c = F.regexp_replace(c, pattern, new)
    return c


def changed_lines(lines: DataFrame, name: str, *groups: str) -> DataFrame:
    """A row a group: lines, and how many of them redaction changes."""
    n = F.sum(F.coalesce(redact(F.col(name)) != F.col(name), F.lit(False)).cast("long"))
    return lines.groupBy(*groups).agg(F.count("*").alias("n_lines"), n.alias("n_changed"))


def tool_family(c: Column) -> Column:
    """tool:<basename of the first token>; an empty command is an error."""
    first = F.split(collapse(c), " ")[0]
    base = F.element_at(F.split(F.regexp_replace(first, r"\\", "/"), "/"), -1)
    return F.when(first == "", F.raise_error(F.lit("a command is empty"))).otherwise(F.concat(F.lit("tool:"), F.lower(base)))


def hash_indicators(c: Column) -> Column:
    """Distinct hex runs of 32, 40 or 64 digits, lower case, in order."""
    runs = F.split(c, "[^A-Fa-f0-9]+")
    return F.array_distinct(F.transform(F.filter(runs, lambda x: F.length(x).isin(32, 40, 64)), F.lower))


def entropy(c: Column) -> Column:
    """Shannon entropy over characters in bits; empty text has none."""
    n = F.length(c)
    chars = F.array_distinct(F.split(c, ""))
    bits = F.aggregate(
        chars, F.lit(0.0),
        lambda acc, x: acc - (n - F.length(F.replace(c, x, F.lit("")))) / n * F.log2((n - F.length(F.replace(c, x, F.lit("")))) / n),
    )
    return F.when(n == 0, F.lit(0.0)).otherwise(bits)
