"""Labels decided by lists of rules: conflicts between sources, repairs, and what a change of rules broke."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BENIGN, CONTEXT, MALICIOUS = "Benign", "Context_Dependent", "Malicious"

# Labels that curators gave, and patterns whose commands are malicious if sources disagree.
CURATED = {
    "pwd": BENIGN, "alias": BENIGN, "uptime": BENIGN, "systemd-detect-virt": BENIGN, "aa-status": BENIGN, "sestatus": BENIGN, "chmod 644 myfile.txt": BENIGN, "cp /tmp/report.csv /home/user/reports/": BENIGN,
    "cat /etc/passwd": CONTEXT, "ssh -D 1080 -fNq user@10.0.0.1": CONTEXT, "chisel client 10.0.0.1:8080 R:1080:socks": CONTEXT,
    "dd if=/dev/zero of=/dev/sda bs=1M": MALICIOUS, "mkfs.ext4 /dev/sda1": MALICIOUS, "iptables -F && iptables -P INPUT ACCEPT && iptables -P FORWARD ACCEPT": MALICIOUS,
}
INDICATORS = (
    r"/dev/tcp/", r"mkfifo\s.*/tmp/", r"\bexec\s+\d+<>/dev/", r"curl\s.*\|\s*(?:ba)?sh", r"wget\s.*\|\s*(?:ba)?sh", r"curl\s.*-o\s.*/tmp/.*&&.*chmod", r"wget\s.*-O\s.*/tmp/.*&&.*chmod", r"base64\s+-d.*\|\s*(?:ba)?sh",
    r"eval\s.*\$\(", r"-enc\s+[A-Za-z0-9+/=]{20,}", r"evil\.com", r"malware\.", r"attacker\.", r"c2\.", r"/etc/shadow", r"mimikatz", r"sekurlsa", r"hashdump", r"crontab.*\|.*(?:ba)?sh", r"/etc/sudoers", r"chmod\s+(?:u\+s|4[0-7]{3})\s+/(?:bin|usr/bin|sbin)/",
)

# Patterns of the repairs.
CREDENTIALS = r"(?:mimikatz|sekurlsa|hashdump|lsass|unshadow|john.*rockyou|secretsdump)"
ESCALATION = r"(?:chmod\s+4[0-7]{3}\s+/|chmod\s+u\+s\s+|echo.*ALL.*sudoers|useradd\s+-o\s+-u\s+0)"
TUNNEL = r"ssh\s+.*-[DLR]\s"
TRACE = r"^\s*(?:sudo\s+)?(?:tcpdump|strace|ltrace)\b"
MUNDANE = r"^\s*(?:ls\s|cat\s+/proc/(?:cpuinfo|meminfo|version)|stat\s+/proc/|ip\s+(?:addr|link|neigh|route)\s*$|docker\s+ps|uname\b|hostname\b|whoami|id\s*$|date\s*$|uptime|df\s|free\s|mount\s*$|env\s*$|printenv)"
#: (repair, label it applies to, pattern, new label); the first that holds decides.
REPAIRS = (
    ("credentials", BENIGN, CREDENTIALS, MALICIOUS), ("tunnel", BENIGN, TUNNEL, CONTEXT), ("trace", BENIGN, TRACE, CONTEXT),
    ("mundane", CONTEXT, MUNDANE, BENIGN), ("credentials_in_context", CONTEXT, CREDENTIALS, MALICIOUS), ("escalation", CONTEXT, ESCALATION, MALICIOUS),
)


def decided(rules: list[tuple[str, Column, Column]]) -> Column:
    """struct(label, basis) of the first rule (basis, condition, label) whose condition holds; null if none does."""
    out = None
    for basis, holds, label in reversed(rules):
        found = F.struct(label.cast("string").alias("label"), F.lit(basis).alias("basis"))
        out = F.when(holds, found) if out is None else F.when(holds, found).otherwise(out)
    return out


def resolved_conflicts(rows: DataFrame, command: str = "command", label: str = "label", curated: dict[str, str] = CURATED) -> DataFrame:
    """One row a command (white space collapsed): label, basis, the labels it had and n_rows.

    A curator's label wins over all; then what all sources agree on; then, of sources that differ, malicious if an indicator is in
    the command, else needing context if any says so, else benign.  Null commands are left out.
    """
    key = F.regexp_replace(F.regexp_replace(F.col(command), r"^\s+|\s+$", ""), r"\s+", " ")
    one = rows.select(key.alias("command"), F.col(label).alias("l")).filter("command is not null").groupBy("command").agg(F.array_sort(F.collect_set("l")).alias("labels"), F.count("*").alias("n_rows"))
    given = F.element_at(F.create_map(*[F.lit(x) for kv in curated.items() for x in kv]), F.col("command"))
    chain = [
        ("curated", given.isNotNull(), given), ("agreed", F.size("labels") == 1, F.col("labels")[0]), ("indicator", F.col("command").rlike("(?i)" + "|".join(INDICATORS)), F.lit(MALICIOUS)),
        ("context", F.array_contains("labels", CONTEXT), F.lit(CONTEXT)), ("benign", F.lit(True), F.lit(BENIGN)),
    ]
    return one.withColumn("d", decided(chain)).select("command", "d.label", "d.basis", "labels", "n_rows")


def repaired(rows: DataFrame, command: str = "command", label: str = "label") -> DataFrame:
    """rows with the label repaired, original_label and the repair that did it (null where none applies)."""
    rules = [(name, (F.col(label) == was) & F.col(command).rlike("(?i)" + pattern), F.lit(now)) for name, was, pattern, now in REPAIRS]
    found = rows.withColumns({"original_label": F.col(label), "repair": decided(rules)})
    return found.withColumns({label: F.coalesce("repair.label", F.col(label)), "repair": F.col("repair.basis")})


def transitions(rows: DataFrame) -> DataFrame:
    """original_label, label, repair and n of repaired rows."""
    return rows.groupBy("original_label", "label", "repair").agg(F.count("*").alias("n"))


def break_groups(df: DataFrame, before: str, after: str, truth: str, rules: str = "fired_rules") -> DataFrame:
    """rule_set (sorted), n, n_truths: the rows that were right before and are wrong after, by the set of rules that fired."""
    broke = (F.col(before) == F.col(truth)) & (F.col(after) != F.col(truth))
    # the test is on a column made beside the rules: a filter below them would write them all out again
    rows = df.select(F.array_sort(F.array_distinct(rules)).alias("rule_set"), F.when(broke, F.col(truth)).alias("t"))
    return rows.groupBy("rule_set").agg(F.count("t").alias("n"), F.count_distinct("t").alias("n_truths")).filter("n > 0")


def rolled_up(groups: DataFrame, least: int = 1) -> DataFrame:
    """rules, n, n_sets: how many breaks' rule sets hold each rule and each pair of rules; sets are counted first, so that each is taken apart once."""
    s = F.col("rule_set")
    pairs = F.flatten(F.transform(s, lambda x, i: F.transform(F.slice(s, i + 2, F.size(s)), lambda y: F.array(x, y))))
    parts = groups.select(F.explode(F.concat(F.transform(s, lambda x: F.array(x)), pairs)).alias("rules"), "n")
    return parts.groupBy("rules").agg(F.sum("n").alias("n"), F.count("*").alias("n_sets")).filter(F.col("n") >= least)


def top_offenders(df: DataFrame, before: str, after: str, truth: str, top: int, rules: str = "fired_rules") -> DataFrame:
    """The rules that broke most (ties: fixed least, then by name): fires, fixes, breaks and the most frequent broken truth."""
    was, now = F.col(before) == F.col(truth), F.col(after) == F.col(truth)
    each = df.select(F.explode_outer(rules).alias("rule"), F.col(truth).alias("t"), (~was & now).cast("long").alias("fixed"), (was & ~now).cast("long").alias("broke")).filter("rule is not null")
    by = each.groupBy("rule", "t").agg(F.count("*").alias("fires"), F.sum("fixed").alias("fixes"), F.sum("broke").alias("breaks"))
    most = F.max_by("t", F.struct("breaks", -F.col("t")))
    return by.groupBy("rule").agg(F.sum("fires").alias("fires"), F.sum("fixes").alias("fixes"), F.sum("breaks").alias("breaks"), most.alias("most_broken")).orderBy(F.desc("breaks"), "fixes", "rule").limit(top)


def prevalence(records: DataFrame, host: str) -> DataFrame:
    """type, value, n, n_hosts (exact) and hosts, a mergeable sketch of them, of indicator records."""
    return records.groupBy("type", "value").agg(F.count("*").alias("n"), F.count_distinct(host).alias("n_hosts"), F.hll_sketch_agg(host).alias("hosts"))


def hosts_by_type(counted: DataFrame) -> DataFrame:
    """type, about: the estimated number of hosts of each type, merged from the sketches of its values, without a second pass over records."""
    return counted.groupBy("type").agg(F.hll_sketch_estimate(F.hll_union_agg("hosts")).alias("about"))
