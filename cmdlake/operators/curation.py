"""Table operators for labelled command corpora: cleaning, joins, quotas, reviews, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cmdlake.functions.text import strip
from cmdlake.operators.ranking import sums_before

# Fixed values.
TAGS = (
    ("downloads_remote_resource", "REMOTE_FETCH"), ("transfers_file_to_remote", "REMOTE_UPLOAD"), ("writes_executable_like_file", "WRITE_EXECUTABLE"), ("archive_create", "ARCHIVE_CREATE"), ("archive_extract", "ARCHIVE_EXTRACT"),
    ("creates_scheduled_task", "TASK_CREATE"), ("modifies_registry_autorun", "REGISTRY_AUTORUN"), ("creates_or_modifies_service", "SERVICE_CREATE"), ("uses_encoded_payload", "ENCODED_PAYLOAD"), ("uses_obfuscation", "OBFUSCATED"),
    ("executes_inline_code", "INLINE_EXEC"), ("runs_interpreter", "INTERPRETER"), ("uses_signed_proxy_binary", "SIGNED_PROXY"), ("remote_execution_or_session", "REMOTE_EXEC"), ("deletes_shadow_copies", "SHADOW_DELETE"),
    ("reads_credential_store", "CRED_ACCESS"), ("enumerates_identity", "ENUM_IDENTITY"), ("enumerates_network_config", "ENUM_NETWORK"),
)
PHRASES = (
    ("uses_encoded_payload OR uses_obfuscation", "encoded/obfuscated execution"), ("downloads_remote_resource", "remote resource download"), ("executes_inline_code", "inline code execution"), ("modifies_registry_autorun", "registry autorun persistence"),
    ("creates_scheduled_task", "scheduled task creation"), ("deletes_shadow_copies", "shadow copy deletion"), ("remote_execution_or_session", "remote session/execution"), ("enumerates_identity", "identity enumeration"),
    ("reads_credential_store", "credential store access"), ("uses_signed_proxy_binary", "signed binary proxy execution"),
)


def cleaned_command(c: Column) -> Column:
    """A corpus line as a command: placeholders resolved, prompts off, white space collapsed; null if it is no command."""
    s = F.regexp_replace(F.regexp_replace(strip(c), r"\{\{\s*([^{}]+?)\s*\}\}", "$1"), r"#\{\s*([^{}:]+?)\s*(?::[^{}]*)?\}", r"\$$1")
    s = F.regexp_replace(F.regexp_replace(s, r"^\s*[$#>]\s+", ""), r"^\s*PS[^>]*>\s+", "")
    s = strip(F.regexp_replace(s, r"\s+", " "))
    return F.when(F.length(s).between(2, 2048) & s.rlike("[A-Za-z]") & ~s.rlike(r"^(\||- |\* |> )"), s)


def script_line(c: Column) -> Column:
    """A line of a script block as a command of its own; null for comments, assignments and left-over punctuation."""
    s = strip(c)
    noise = s.startswith("#") | s.rlike(r"^(\$[A-Za-z_]\w*|[A-Z][A-Z0-9_]*|export\s+[A-Za-z_]\w*)\s*=") | s.rlike(r"^[!:\\]") | s.rlike(r"^[|&;<>{}()\[\]\s]+$") | s.isin("EOF", "EOT", "END", "}", ")", "]", "'", '"')
    return F.when((s != "") & ~noise, s)


def row_group(command: Column, *fields: str) -> Column:
    """The first non-empty group field, tagged with its name, else the command."""
    return F.coalesce(*[F.when(F.col(f).cast("string") != "", F.concat(F.lit(f"{f}:"), F.col(f).cast("string"))) for f in fields], command)


def two_way_target(routine: Column, context: Column, abuse: Column) -> Column:
    """struct(routine, non_benign, ordinal_risk) of a three-way soft target; values outside [0, 1] or a zero sum are errors."""
    total = routine + context + abuse
    wrong = (F.least(routine, context, abuse) < 0) | (F.greatest(routine, context, abuse) > 1) | (total <= 0)
    part = F.when(wrong, F.raise_error(F.lit("a soft target is out of range"))).otherwise((context + abuse) / total)
    return F.struct((routine / total).alias("routine"), part.alias("non_benign"), (part * 0.5).alias("ordinal_risk"))


def fused(primary: Column, raw: Column, policy: str) -> Column:
    """Probability vector of the chosen view: raw, decoded or the mean of both."""
    if policy not in ("raw", "decoded", "mean"):
        raise ValueError(f"no such view policy: {policy}")
    mean = F.zip_with(primary, raw, lambda a, b: (a + b) / 2)
    return F.when(raw.isNull(), primary).otherwise({"raw": raw, "decoded": primary, "mean": mean}[policy])


def top_two(probs: Column, labels: list[str]) -> Column:
    """struct(label, second_label, label_conf, second_conf, decision_margin); of equal values the earlier label first."""
    ranked = F.array_sort(F.transform(probs, lambda p, i: F.struct((-p).alias("p"), i.alias("i"))))
    name = lambda k: F.element_at(F.array(*map(F.lit, labels)), ranked[k]["i"] + 1)
    return F.struct(name(0).alias("label"), name(1).alias("second_label"), (-ranked[0]["p"]).alias("label_conf"), (-ranked[1]["p"]).alias("second_conf"), (ranked[1]["p"] - ranked[0]["p"]).alias("decision_margin"))


def consistency(gate: Column, families: Column, benign: str) -> Column:
    """How a gate's label and the selected families agree."""
    plain, attack = F.array_contains(families, benign), F.exists(families, lambda f: f != benign)
    return (
        F.when(families.isNull(), "not_evaluated").when(plain & ~attack & (gate != "Benign"), "gate_family_disagreement").when(plain & ~attack, "benign_family_candidate")
        .when(plain & attack, "mixed_family_prediction").when(attack, "attack_family_candidate").otherwise("no_family_selected")
    )


def top_k(scores: Column, k: int, least: float = 0.0) -> Column:
    """The k best members of an array of struct(name, score) by falling score, then name."""
    ranked = F.array_sort(F.transform(F.filter(scores, lambda s: s["score"] >= least), lambda s: F.struct((-s["score"]).alias("r"), s["name"].alias("name"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["name"])


def semantic_tags() -> Column:
    """Tags of a row of with_semantics, in order."""
    return F.array_compact(F.array(*[F.when(F.col(f), tag) for f, tag in TAGS]))


def tagged_text(command: str = "text") -> Column:
    """TAGS | command, the command alone where no tag holds; the decoded form where there is one."""
    shown = F.coalesce("deobfuscated_command", command)
    return F.when(F.size(semantic_tags()) > 0, F.concat(F.array_join(semantic_tags(), " "), F.lit(" | "), shown)).otherwise(shown)


def summary_sentence() -> Column:
    """A sentence on a row of with_semantics."""
    parts = F.array_compact(F.array(F.when(F.col("executable") != "", F.col("executable")), *[F.when(F.expr(cond), words) for cond, words in PHRASES]))
    more = F.concat(parts[0], F.lit(" displaying "), F.array_join(F.slice(parts, 2, 99), ", "))
    return F.when(F.size(parts) == 0, "No prominent high-signal indicators detected").when(F.size(parts) > 1, more).otherwise(F.concat(parts[0], F.lit(" execution")))


def against_existing(new: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """new with status: existing, internal_duplicate (not the first of its key) or accepted."""
    known = existing.select(key).distinct().withColumn("known", F.lit(True))
    first = new.groupBy(key).agg(F.min(order).alias("first"))
    status = F.when(F.col("known"), "existing").when(F.col(order) > F.col("first"), "internal_duplicate").otherwise("accepted")
    return new.join(known, key, "left").join(first, key).withColumn("status", status).drop("known", "first")


def reconciled(left: DataFrame, right: DataFrame, third: DataFrame, key: str) -> DataFrame:
    """key, verdict, status of two reviewers' verdicts; where they differ the third decides, or the row stays unresolved."""
    both = left.select(key, F.col("verdict").alias("a")).join(right.select(key, F.col("verdict").alias("b")), key).join(third.select(key, F.col("verdict").alias("c")), key, "left")
    return both.select(key, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("c")).alias("verdict"), F.when((F.col("a") == F.col("b")) | F.col("c").isNotNull(), "accepted").otherwise("unresolved").alias("status"))


def largest_remainder(counts: DataFrame, name: str, n: str, total: int) -> DataFrame:
    """Quotas that add up to ``total``, by share of ``n``; the table is one row a bucket, so small."""
    share = F.col(n) * total / F.sum(n).over(Window.partitionBy())
    base = counts.withColumns({"floor": F.floor(share), "part": share - F.floor(share)})
    rank = F.row_number().over(Window.orderBy(F.desc("part"), name))
    left = F.lit(total) - F.sum("floor").over(Window.partitionBy())
    return base.select(name, n, (F.col("floor") + F.when(rank <= left, 1).otherwise(0)).cast("long").alias("quota"))


def ratio_deficits(counts: dict[str, int], ratios: dict[str, float], base: str) -> dict[str, int]:
    """Rows missing by class until every class but ``base`` has its share of the total that keeps all rows."""
    if min(ratios.values()) <= 0 or abs(sum(ratios.values()) - 1) > 1e-6:
        raise ValueError("class ratios must be positive and sum to 1")
    up = lambda x: -int(-x // 1)
    total = max(sum(counts.values()), *[up(n / ratios[c]) for c, n in counts.items() if n])
    return {c: 0 if c == base else max(counts[c], up(total * r)) - counts[c] for c, r in ratios.items()}


def held_out_groups(rows: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """rows with holdout: whole groups in a hashed order until their rows reach the share; sums run over slots of groups, never over all in one task."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")), 256)
    marked = sums_before(sizes, order, "n", "before", "all").select(group, (F.col("before") < F.round(F.col("all") * share)).alias("holdout"))
    return rows.join(marked, group)


def label_report(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1 of array columns of labels."""
    each = rows.select(F.explode(F.array_union(truth, predicted)).alias("label"), truth, predicted)
    t, p = F.array_contains(truth, F.col("label")), F.array_contains(predicted, F.col("label"))
    n = each.groupBy("label").agg(*[F.sum(c.cast("long")).alias(x) for x, c in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p))])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select("label", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def cell_list(c: Column) -> Column:
    """A review cell as a list: [json], or parts between semicolons; empty, null and None are null."""
    s = strip(c)
    parts = F.filter(F.transform(F.split(s, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when((s == "") | s.isin("null", "None"), None).when(s.startswith("["), F.from_json(s, "array<string>")).otherwise(parts)
