"""From rule classes to techniques: prior vectors, candidate masks, their use on scores and their coverage.

The tables are small and fixed, so they are literals in the plan, and a row's mask is array work without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
TECHNIQUES = {
    "persistence:registry_run_key": ("T1547",), "persistence:scheduled_task": ("T1053",), "persistence:create_modify_system_process": ("T1543",), "persistence:event_triggered_execution": ("T1546",),
    "persistence:boot_logon_autostart_execution": ("T1547", "T1037"), "persistence:hijack_execution_flow": ("T1574",), "persistence:account_manipulation": ("T1098", "T1136"),
    "execution:command_and_scripting_interpreter": ("T1059",), "execution:windows_management_instrumentation": ("T1047",), "execution:native_api": ("T1106",), "defense_evasion:signed_binary_proxy_execution": ("T1218",),
    "defense_evasion:obfuscated_files_or_information": ("T1027",), "defense_evasion:deobfuscate_decode_files": ("T1140",), "defense_evasion:modify_registry": ("T1112",), "defense_evasion:impair_defenses": ("T1562",),
    "defense_evasion:file_permissions_modification": ("T1222",), "defense_evasion:indicator_removal": ("T1070",), "defense_evasion:hide_artifacts": ("T1564",), "defense_evasion:masquerading": ("T1036",),
    "command_and_control:ingress_tool_transfer": ("T1105",), "collection:archive_collected_data": ("T1560",), "collection:data_from_local_system": ("T1005",), "exfiltration:exfiltration_over_c2_channel": ("T1048",),
    "credential_access:os_credential_dumping": ("T1003", "T1555"), "privilege_escalation:abuse_elevation_control": ("T1548",), "impact:inhibit_system_recovery": ("T1490",), "impact:data_destruction": ("T1485",),
    "discovery:account_discovery": ("T1087",), "discovery:query_registry": ("T1012",), "discovery:system_network_configuration_discovery": ("T1016",), "discovery:remote_system_discovery": ("T1018",),
    "discovery:file_and_directory_discovery": ("T1083",), "discovery:system_information_discovery": ("T1082",), "discovery:process_discovery": ("T1057",), "lateral_movement:remote_services": ("T1021",),
}
NEIGHBOURS = {
    "T1547": ("T1546", "T1037", "T1543"), "T1053": ("T1546", "T1082"), "T1543": ("T1569", "T1547"), "T1059": ("T1202", "T1106", "T1562", "T1546", "T1005"), "T1047": ("T1059",), "T1218": ("T1216", "T1127", "T1105"),
    "T1027": ("T1140", "T1564"), "T1140": ("T1027",), "T1105": ("T1071", "T1218"), "T1560": ("T1074",), "T1048": ("T1567",), "T1490": ("T1485", "T1486", "T1489"), "T1087": ("T1033", "T1069", "T1078"), "T1016": ("T1049", "T1082"),
    "T1018": ("T1046",), "T1112": ("T1547", "T1562", "T1012"), "T1562": ("T1112", "T1070", "T1548", "T1222"), "T1222": ("T1548",), "T1070": ("T1485", "T1562"), "T1564": ("T1027", "T1036", "T1574"), "T1036": ("T1574", "T1564"),
    "T1106": ("T1059", "T1055"), "T1083": ("T1082", "T1057"), "T1082": ("T1083", "T1057", "T1518"), "T1057": ("T1082", "T1083"), "T1003": ("T1555", "T1552"), "T1555": ("T1003", "T1552"), "T1552": ("T1003", "T1555"),
    "T1546": ("T1547", "T1053", "T1543"), "T1574": ("T1036", "T1547", "T1564"), "T1098": ("T1136", "T1078"), "T1136": ("T1098",), "T1548": ("T1222", "T1134"), "T1485": ("T1070", "T1490"), "T1005": ("T1074", "T1560"),
    "T1037": ("T1547", "T1546"), "T1055": ("T1106", "T1134"), "T1134": ("T1055", "T1548"), "T1518": ("T1082", "T1057"), "T1078": ("T1098", "T1087"), "T1012": ("T1112", "T1082"),
}
TACTICS = {
    "defense_evasion": ("T1027", "T1036", "T1070", "T1112", "T1140", "T1218", "T1222", "T1553", "T1562", "T1564", "T1574", "T1202", "T1216", "T1220", "T1480", "T1497", "T1622", "T1620"),
    "execution": ("T1047", "T1059", "T1106", "T1129", "T1204", "T1559", "T1569"), "persistence": ("T1037", "T1053", "T1098", "T1136", "T1137", "T1505", "T1543", "T1546", "T1547", "T1556", "T1554", "T1078"),
    "discovery": ("T1007", "T1012", "T1016", "T1018", "T1033", "T1040", "T1046", "T1049", "T1057", "T1069", "T1082", "T1083", "T1087", "T1124", "T1135", "T1201", "T1217", "T1482", "T1518", "T1526", "T1580", "T1614", "T1619", "T1652"),
    "credential_access": ("T1003", "T1056", "T1110", "T1528", "T1539", "T1550", "T1552", "T1555", "T1558"), "privilege_escalation": ("T1055", "T1134", "T1484", "T1548", "T1611"),
    "impact": ("T1485", "T1486", "T1489", "T1490", "T1491", "T1529", "T1531"), "collection": ("T1005", "T1074", "T1113", "T1114", "T1115", "T1119", "T1530", "T1560"),
    "command_and_control": ("T1001", "T1071", "T1090", "T1105", "T1132", "T1205", "T1219", "T1573"), "lateral_movement": ("T1021", "T1570"), "exfiltration": ("T1041", "T1048", "T1567"),
    "initial_access": ("T1156", "T1566", "T1680"), "resource_development": ("T1127",),
}
ADJACENT = {
    "execution": ("defense_evasion", "persistence"), "defense_evasion": ("execution", "persistence", "privilege_escalation"), "persistence": ("execution", "privilege_escalation", "defense_evasion"),
    "discovery": ("credential_access", "collection"), "credential_access": ("discovery", "privilege_escalation"), "privilege_escalation": ("defense_evasion", "persistence"), "collection": ("exfiltration", "discovery"),
    "lateral_movement": ("discovery", "credential_access"), "command_and_control": ("exfiltration",), "impact": ("defense_evasion",),
}
ALPHA = {"strong": 2.0, "weak": 1.5, "none": 0.0}
MASKED = -1e9


def _through(table: dict[str, tuple[str, ...]], names: Column) -> Column:
    """All that the table gives for the names."""
    listed = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.flatten(F.array_compact(F.transform(names, lambda n: F.try_element_at(listed, n)))))


def prior_vector(priors: Column, strength: Column, space: list[str], alpha: dict[str, float] = ALPHA) -> Column:
    """For each technique of the space the largest prior of its classes, times the strength's alpha."""
    given = F.transform(F.map_entries(priors), lambda e: F.struct(_through(TECHNIQUES, F.array(e["key"])).alias("ids"), e["value"].alias("w")))
    best = lambda all_, t: F.coalesce(F.array_max(F.transform(F.filter(all_, lambda g: F.array_contains(g["ids"], t)), lambda g: g["w"])), F.lit(0.0))
    scale = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in alpha.items() for x in kv]), strength), F.lit(0.0))
    # as an array's one member, so that a row's classes are looked up once and not for each technique
    return F.transform(F.array(F.struct(given.alias("all"), scale.alias("scale"))), lambda x: F.transform(F.array(*map(F.lit, space)), lambda t: best(x["all"], t) * x["scale"]))[0]


def open_candidates(df: DataFrame, space: list[str]) -> DataFrame:
    """with_rules' rows with candidates (sorted) and used_fallback, which depend on the command alone.

    Strong rules add neighbours and their tactics' techniques; weak ones two steps of neighbours and adjacent tactics;
    without rules, or where nothing is left, the whole space is open.
    """
    inside = F.array(*map(F.lit, space))
    df = df.withColumns({"banned_ids": _through(TECHNIQUES, F.col("banned_classes")), "named": F.array_intersect(_through(TECHNIQUES, F.col("candidate_classes")), inside)})
    df = df.withColumn("named", F.array_except("named", "banned_ids"))
    tactics = F.array_distinct(F.transform("candidate_classes", lambda c: F.split(c, ":")[0]))
    allowed = lambda ids: F.array_except(F.array_intersect(ids, inside), F.col("banned_ids"))
    df = df.withColumn("hop", allowed(_through(NEIGHBOURS, F.col("named"))))
    strong = F.concat("named", "hop", allowed(_through(TACTICS, tactics)))
    weak = F.concat("named", "hop", allowed(_through(NEIGHBOURS, F.col("hop"))), allowed(_through(TACTICS, F.concat(tactics, _through(ADJACENT, tactics)))))
    some = F.size("named") > 0
    df = df.withColumn("used_fallback", (F.col("rule_strength") == "none") | ~some)
    df = df.withColumn("candidates", F.array_sort(F.when(F.col("used_fallback"), inside).otherwise(F.array_distinct(F.when(F.col("rule_strength") == "strong", strong).otherwise(weak)))))
    return df.drop("banned_ids", "named", "hop")


def with_mask(df: DataFrame, space: list[str], truth: str | None = None) -> DataFrame:
    """open_candidates' rows with candidate_mask over the space, whose members differ, num_candidates and organic.

    ``organic`` tells whether the true label, which the mask always opens, was open before; null if it is null or outside
    the space.
    """
    inside = F.array(*map(F.lit, space))
    label = F.col(truth) if truth else F.lit(None).cast("string")
    df = df.withColumn("organic", F.when(F.array_contains(inside, label), F.array_contains("candidates", label)))
    df = df.withColumn("candidate_mask", F.transform(inside, lambda t: (F.array_contains("candidates", t) | F.coalesce(t == label, F.lit(False))).cast("int")))
    return df.withColumn("num_candidates", F.size("candidates") + F.when(~F.col("organic"), 1).otherwise(0))


def with_candidates(df: DataFrame, space: list[str], truth: str | None = None) -> DataFrame:
    """with_rules' rows with candidates, used_fallback, candidate_mask, num_candidates and organic."""
    return with_mask(open_candidates(df, space), space, truth)


def masked_scores(scores: Column, mask: Column, low: float = MASKED) -> Column:
    return F.zip_with(scores, mask, lambda s, m: s * m + (1 - m) * F.lit(low))


def fused_scores(scores: Column, priors: Column, alpha: float = 1.0) -> Column:
    return F.zip_with(scores, priors, lambda s, p: s + F.lit(alpha) * p)


def coverage(df: DataFrame) -> DataFrame:
    """One row on with_candidates: shares of organic and fallback rows, sizes, and the upper median, all from counts by size."""
    each = df.groupBy("num_candidates").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("organic"), F.lit(False)).cast("long")).alias("organic"), F.sum(F.col("used_fallback").cast("long")).alias("fallback"))
    share = lambda c: F.round(F.sum(c) / F.sum("n") * 100, 2)
    sizes = F.array_sort(F.collect_list(F.struct("num_candidates", "n")))  # at most one entry a technique
    out = each.agg(
        F.sum("n").alias("total"), F.sum("organic").alias("organic"), share("organic").alias("organic_pct"), F.sum("fallback").alias("fallback"), share("fallback").alias("fallback_pct"),
        F.round(F.sum(F.col("n") * F.col("num_candidates")) / F.sum("n"), 2).alias("mean_size"), F.min("num_candidates").alias("min_size"), F.max("num_candidates").alias("max_size"), sizes.alias("sizes"),
    )
    upto = lambda s: F.aggregate(F.filter("sizes", lambda o: o["num_candidates"] <= s["num_candidates"]), F.lit(0).cast("long"), lambda a, o: a + o["n"])
    return out.withColumn("median_size", F.filter("sizes", lambda s: upto(s) > F.floor(F.col("total") / 2))[0]["num_candidates"]).drop("sizes")
