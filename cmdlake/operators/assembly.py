"""Datasets put together: reserves, quotas, augmentation, isolated splits, oversampling, gates, policies, queues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cmdlake.operators.ranking import ranked

# Soft targets (routine, needs context, direct abuse), basis and source by bucket.
_STRESS, _HARD, _CONTEXTUAL, _ABUSE, _OLD = "expanded_benign_stress", "hard_negative_context", "expanded_benign_contextual", "hard_negative_abuse", "existing_3class_train_non_synthetic"
POLICIES = (
    ("linux_admin", 0.85, 0.15, 0.0, "routine_linux_admin_inspection", _STRESS), ("docker", 0.85, 0.15, 0.0, "routine_container_inspection", _STRESS), ("kubernetes", 0.75, 0.25, 0.0, "routine_kubernetes_operations_with_context_relevance", _STRESS),
    ("logs", 0.75, 0.25, 0.0, "routine_log_review_with_context_relevance", _STRESS), ("networking_benign", 0.75, 0.25, 0.0, "routine_network_inspection", _STRESS), ("filesystem_matrix", 0.85, 0.15, 0.0, "routine_filesystem_inventory", _STRESS),
    ("linux_service_matrix", 0.85, 0.15, 0.0, "routine_service_inventory", _STRESS), ("config_review", 0.75, 0.25, 0.0, "routine_config_review_with_context_relevance", _STRESS), ("package_managers", 0.85, 0.15, 0.0, "routine_package_inventory", _STRESS),
    ("context_recon", 0.15, 0.80, 0.05, "dual_use_recon_without_telemetry", _HARD), ("context_sensitive_access", 0.15, 0.75, 0.10, "sensitive_access_without_direct_abuse", _HARD), ("cloud_cli", 0.20, 0.75, 0.05, "cloud_inventory_needs_context", _CONTEXTUAL),
    ("database_admin", 0.20, 0.75, 0.05, "database_inventory_needs_context", _CONTEXTUAL), ("existing_context_non_synthetic", 0.15, 0.80, 0.05, "existing_context_label_non_synthetic", _OLD), ("malicious_execution", 0.0, 0.05, 0.95, "direct_remote_execution_abuse", _ABUSE),
    ("malicious_persistence", 0.0, 0.05, 0.95, "direct_persistence_abuse", _ABUSE), ("malicious_impact", 0.0, 0.05, 0.95, "direct_impact_abuse", _ABUSE), ("context_sensitive_access_malicious", 0.0, 0.05, 0.95, "credential_material_access_with_direct_abuse", _ABUSE),
    ("existing_malicious_non_synthetic", 0.0, 0.05, 0.95, "existing_malicious_label_non_synthetic", _OLD),
)
#: Families of threat patterns in order: each list of groups needs one member of every group.
THREATS = (
    ("reverse_shell_family", (("/dev/tcp/", "nc -e", "socket.socket", "fsockopen", "tcpsocket.open", "socat exec", "/bin/sh -i"),)),
    ("remote_payload_execution_family", (("curl", "wget", "invoke-webrequest", "bitsadmin", "certutil"), ("| bash", "| sh", " && /tmp/", "payload.exe", "downloadstring"))),
    ("persistence_family", (("authorized_keys", "sudoers", " crontab ", "/etc/cron", "currentversion\\run", "schtasks ", "startup", "rc.local", "launchagents", "systemctl enable malicious", "useradd -o -u 0"),)),
    ("impact_family", (("rm -rf /", "dd if=/dev/zero", "mkfs.", "delete shadows", "delete catalog", "cipher /w:", "wevtutil cl", "disable auditd", "disable realtimemonitoring", "ufw disable", "setenforce 0", "shred -u", "truncate -s 0"),)),
    ("sensitive_exfil_family", (("curl", "wget"), ("@/etc/", "@/root/.ssh", "@/var/log/"))),
)
RUBRIC = (
    ("network_transfer", ("curl ", "wget ", "scp ", "rsync ", "ssh ")), ("code_execution", ("base64", "openssl enc", "python -c", "bash -i", "/bin/sh", "powershell", "cmd.exe")),
    ("file_or_system_modification", ("chmod ", "chown ", "mv ", "cp ", "dd if=", "mkfs", "mount ")), ("remote_mount", ("sshfs", "mount ")),
)
PLAIN = ("ls ", "pwd", "whoami", "id ", "uname", "cat ", "echo ", "head ", "tail ", "df ", "ps ", "find ", "grep ", "which ", "stat ", "getfacl", "file ", "tar ", "zip ", "mkdir ", "touch ", "chmod ", "chown ", "mount ", "umount ", "sshfs", "scp ", "rsync ")
DOUBTFUL = (
    "base64", "wget ", "curl ", "nc ", "ncat ", "openssl enc", "powershell", "bash -i", "/bin/sh", "sh -c", "python -c", "perl -e", "ruby -e", "eval", "cmd.exe", "bitsadmin", "git clone", "curl -fsSL", "chmod 777", "mkfs", "dd if=",
    "> /dev/tcp", "systemctl", "service ", "nohup ", "at ", "crontab", "launchctl", "schtasks", "regsvr32", "rundll32", "wmic ", "mshta", "certutil", "bitsadmin", "socat", "ssh -i", "scp ", "sshfs",
)
SLOTS = (("ip", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"), ("account", r"\b[A-Za-z0-9_]+@[A-Za-z0-9.]+\b"), ("tmp", r"/tmp/[A-Za-z0-9._]+"), ("port", r":\d{2,5}\b"))


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(text, p))


def threat_family(command: Column) -> Column:
    """The first family of threat patterns that a command shows; null if none."""
    low, found = F.lower(command), None
    for name, groups in THREATS:
        hit = any_of(low, groups[0]) if len(groups) == 1 else any_of(low, groups[0]) & any_of(low, groups[1])
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found


def rubric_review(command: Column) -> Column:
    """struct(behaviours, verdict, authorization, provisional) by words alone: a stopgap, marked as provisional."""
    low = F.lower(F.trim(command))
    said = F.array_compact(F.array(*[F.when(any_of(low, parts), name) for name, parts in RUBRIC]))
    benign = any_of(low, PLAIN) & ~any_of(low, DOUBTFUL)
    return F.struct(
        F.when(F.size(said) > 0, said).otherwise(F.array(F.lit("command_observed"))).alias("behaviours"), F.when(benign, "Benign").otherwise("Context_Dependent").alias("verdict"),
        F.when(benign & F.contains(low, F.lit("sudo")), "authorized").otherwise("unknown").alias("authorization"), F.lit(True).alias("provisional"),
    )


def with_policy(df: DataFrame, bucket: str) -> DataFrame:
    """df with soft_target, label_basis and source_type of its bucket; buckets without a policy go."""
    spark = df.sparkSession
    table = spark.createDataFrame(list(POLICIES), f"`{bucket}` string, routine double, context double, abuse double, label_basis string, source_type string")
    whole = F.col("routine") + F.col("context") + F.col("abuse")
    target = F.struct(*[F.round(F.col(c) / whole, 6).alias(c) for c in ("routine", "context", "abuse")]).alias("soft_target")
    return df.join(F.broadcast(table.select(bucket, target, "label_basis", "source_type")), bucket)  # as many rows as POLICIES


def topped_up(rows: DataFrame, reserve: DataFrame, key: str, group: str, needed: dict[str, int], order: Column) -> DataFrame:
    """The reserve rows to add: of keys not in rows and of one row a key, the first by a hex digest up to each group's deficit.

    A group whose reserve is too small is an error, raised where its rows are counted.
    """
    unused = reserve.join(rows.select(key).distinct(), key, "left_anti")
    once = unused.groupBy(key).agg(F.min_by(F.struct(*[c for c in unused.columns if c != key]), order).alias("r")).select(key, "r.*")
    wanted = F.create_map(*[x for g, n in needed.items() for x in (F.lit(g), F.lit(n))])
    at = ranked(once.filter(F.col(group).isin(*needed)), order, "__rank", (group,), most=max(needed.values()), total="__size")
    short = F.col("__size") < wanted[F.col(group)]
    checked = at.withColumn("__rank", F.when(short, F.raise_error(F.concat(F.lit("the reserve is too small for "), F.col(group)))).otherwise(F.col("__rank")))
    return checked.filter(F.col("__rank") <= wanted[F.col(group)]).drop("__rank", "__size")


def varied(df: DataFrame, key: str, command: str, pools: dict[str, list[str]], copies: int, share: float = 0.7) -> DataFrame:
    """key, copy, command: copies with addresses, accounts, temporary paths and ports drawn from pools; draws hash (key, copy, slot)."""
    rows = df.select(key, F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"), command)
    text = F.col(command)
    for name, pattern in SLOTS:
        if name in pools:
            draw = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col(key).cast("string"), "copy", F.lit(name)), 256), 1, 8), 16, 10).cast("long")
            value = F.element_at(F.array(*map(F.lit, pools[name])), (draw % len(pools[name]) + 1).cast("int"))
            text = F.when((draw / F.lit(0x100000000)) < share, F.regexp_replace(text, F.lit(pattern), value)).otherwise(text)
    return rows.select(key, "copy", text.alias(command))


def by_quota(rows: DataFrame, key: str, bucket: str, quotas: dict[str, int], total: int, order: Column) -> DataFrame:
    """rows with chosen (quota or fill): one row a key (the first bucket by name wins), each bucket's first rows, then the rest until the total."""
    once = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), F.col(bucket)).alias("r")).select(key, "r.*")
    wanted = F.coalesce(F.try_element_at(F.create_map(*[x for b, n in quotas.items() for x in (F.lit(b), F.lit(n))]), F.col(bucket)), F.lit(0))
    at = ranked(once, order, "__rank", (bucket,)).withColumn("__own", F.col("__rank") <= wanted)
    # quotas first, then the others in hashed order: one global rank of a digest that a leading digit sorts
    lead = F.concat(F.when(F.col("__own"), "0").otherwise("1"), order)
    out = ranked(at, lead, "__all", most=total, digits=4)
    return out.withColumn("chosen", F.when(F.col("__own"), "quota").otherwise("fill")).drop("__rank", "__own", "__all")


def shares(rank: Column, total: Column, train: float = 0.8, validation: float = 0.1) -> Column:
    at = (rank - 1) / total
    return F.when(at < train, "train").when(at < train + validation, "validation").otherwise("test")


def shuffled_split(df: DataFrame, order: Column) -> DataFrame:
    """df with split: 80/10/10 of all rows in hashed order."""
    rows = ranked(df, order, "__rank", total="__size")
    return rows.withColumn("split", shares(F.col("__rank"), F.col("__size"))).drop("__rank", "__size")


def disjoint(df: DataFrame, key: Column, split: str) -> DataFrame:
    """df unchanged; a key in two splits is an error when its row is read."""
    sides = df.groupBy(key.alias("__key")).agg((F.min(split) != F.max(split)).alias("__both"))
    rows = df.withColumn("__key", key).join(sides, "__key")
    return rows.withColumn(split, F.when(F.col("__both"), F.raise_error(F.lit("a key occurs in two splits"))).otherwise(F.col(split))).drop("__key", "__both")


def oversampled(df: DataFrame, label: str, key: str) -> DataFrame:
    """df with copy: each class repeated evenly up to max(median class size, 4 x the smallest); classes are few, their rows stay spread."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    goal = sizes.agg(F.greatest(F.percentile("n", 0.5), 4 * F.min("n")).cast("long").alias("goal"))
    want = sizes.crossJoin(F.broadcast(goal)).select(F.col(label).alias("__label"), "n", F.greatest("n", F.least("goal", F.col("n") * 1000)).alias("want"))
    rows = ranked(df, F.sha2(F.col(key).cast("string"), 256), "__rank", (label,)).join(want, F.col(label).eqNullSafe(F.col("__label")))
    each = F.floor((F.col("want") - F.col("__rank")) / F.col("n")) + 1
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), each.cast("long")))).drop("__label", "n", "want", "__rank")


def soft_label_report(df: DataFrame, key: str) -> DataFrame:
    """By label_basis: rows, mean non-benign share and ordinal risk, and the three smallest keys as examples."""
    t = F.col("soft_target")
    risk = t["context"] + t["abuse"]
    report = df.groupBy("label_basis").agg(F.count("*").alias("n"), F.round(F.avg(risk), 6).alias("non_benign_mean"), F.round(F.avg(risk * 0.5), 6).alias("ordinal_risk_mean"))
    # the first of each slot of keys, then the first of those, so that no basis is sorted whole
    slot = F.pmod(F.xxhash64(key), F.lit(256))
    some = df.select("label_basis", key, slot.alias("__slot")).distinct().withColumn("__n", F.row_number().over(Window.partitionBy("label_basis", "__slot").orderBy(key))).filter("__n <= 3")
    first = some.groupBy("label_basis").agg(F.slice(F.array_sort(F.collect_list(key)), 1, 3).alias("examples"))
    return report.join(first, "label_basis")


def gated(df: DataFrame, wanted: Column, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage applied to the wanted rows only; the others carry nulls in what it adds."""
    run = stage(df.filter(F.coalesce(wanted, F.lit(False))))
    rest = df.filter(~F.coalesce(wanted, F.lit(False)))
    return run.unionByName(rest.select("*", *[F.lit(None).cast(run.schema[c].dataType).alias(c) for c in run.columns if c not in df.columns]))


def fixes_and_breaks(df: DataFrame, before: str, after: str, truth: str, rules: str = "fired_rules") -> DataFrame:
    """rule, fixes, breaks, net, by the rows on which each rule fired."""
    was, now = F.col(before) == F.col(truth), F.col(after) == F.col(truth)
    # outer: a plain explode would push a test of the rules below the projections that find them
    each = df.select(F.explode_outer(rules).alias("rule"), (~was & now).cast("long").alias("fixed"), (was & ~now).cast("long").alias("broke"))
    n = each.filter("rule is not null").groupBy("rule").agg(F.sum("fixed").alias("fixes"), F.sum("broke").alias("breaks"))
    return n.withColumn("net", F.col("fixes") - F.col("breaks"))


def adopted(before: dict[str, float], after: dict[str, float]) -> str:
    """Whether a change helps both, one or no split."""
    better = sum(after[s] > before[s] for s in before)
    return "adopt" if better == len(before) else "skip" if better == 0 else "mixed"


def disagreements(rows: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """rows with a, b and reason: both wrong, only one right, or alike; nothing where both are right."""
    both = rows.join(first.select(key, F.col("label").alias("a")), key).join(second.select(key, F.col("label").alias("b")), key)
    ok_a, ok_b = F.col("a") == F.col("truth"), F.col("b") == F.col("truth")
    reason = F.when(~ok_a & ~ok_b & (F.col("a") == F.col("b")), "both_wrong_alike").when(~ok_a & ~ok_b, "both_wrong_apart").when(~ok_a, "first_wrong").when(~ok_b, "second_wrong")
    return both.withColumn("reason", reason).filter("reason is not null")


def review_queue(found: DataFrame, key: str, template: Column, count: int) -> DataFrame:
    """count rows at most (the queue's own length): one a template, an equal share of each reason, then the rest."""
    rows = found.withColumn("__template", template)
    once = rows.groupBy("__template").agg(F.min_by(F.struct(*found.columns), F.struct("reason", F.sha2(F.col(key).cast("string"), 256))).alias("r")).select("r.*")
    quota = {r: count // 4 for r in ("both_wrong_alike", "both_wrong_apart", "first_wrong", "second_wrong")}
    return by_quota(once, key, "reason", quota, count, F.sha2(F.col(key).cast("string"), 256))
