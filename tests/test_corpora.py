"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from cmdlake.sources import corpora, outputs


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_tables_and_manifest_sources(spark, tmp_path):
    c = put(tmp_path, "a.csv", 'command,label\n"ls, ""x""\nmore",A\n\npwd,B\n')
    j = put(tmp_path, "b.jsonl", '{"command": "id", "label": "own"}\n\n{"command": " ", "label": "x"}\n{"command": "uname -a"}\n')
    h = put(tmp_path, "hist", "# note\n: 12:0;git status\n  7  ls -la\n\n")
    assert {r.command for r in corpora.read_rows(spark, c, "command string, label string").collect()} == {'ls, "x"\nmore', "pwd"}
    got = {(r.command, r.label, r.source_type, r.source_name) for r in corpora.load_sources(spark, [{"kind": "jsonl", "path": j, "label": "given", "source_type": "s", "name": "n"}, {"kind": "history", "path": h, "label": "h", "name": "m"}]).collect()}
    assert got == {("id", "own", "s", "n"), ("uname -a", "given", "s", "n"), ("git status", "h", None, "m"), ("ls -la", "h", None, "m")}
    with pytest.raises(ValueError):
        corpora.load_sources(spark, [{"kind": "other", "path": j}])


def test_pages_and_lines(spark, tmp_path):
    put(tmp_path, "pages/tar.md", "# tar\n\n- Extract:\n\n`tar xf {{file}}`\n\nSee `tar` too.\n")
    put(tmp_path, "pages.de/tar.md", "`tar de`\n")
    assert [r.command for r in corpora.page_corpus(spark, str(tmp_path)).collect()] == ["tar xf file"]
    assert [r.command for r in corpora.line_corpus(spark, put(tmp_path, "l.txt", "$ ls  -la\n> quote\n12\n")).collect()] == ["ls -la", "quote"]


def test_yaml_catalogues(spark, tmp_path):
    pytest.importorskip("yaml")
    put(tmp_path, "t/T1105.001.yaml", "atomic_tests:\n- executor:\n    command: |\n      # note\n      curl http://x/a\n      X=1\n- executor: {}\n")
    put(tmp_path, "t/bad.yaml", "a: [\n")
    put(tmp_path, "l/c.yml", "Commands:\n- {Command: certutil -f a, MitreID: T1105}\n- {Command: x y, MitreID: none}\n")
    put(tmp_path, "g/awk", "functions:\n  shell:\n  - code: awk 'BEGIN'\n  other:\n  - code: awk x\n")
    assert [tuple(r) for r in corpora.attack_tests(spark, str(tmp_path / "t")).collect()] == [("curl http://x/a", "T1105")]
    assert [tuple(r) for r in corpora.binary_catalogue(spark, str(tmp_path / "l")).collect()] == [("certutil -f a", "T1105")]
    assert [tuple(r) for r in corpora.function_catalogue(spark, str(tmp_path / "g"), {"shell": "T1059"}).collect()] == [("awk 'BEGIN'", "T1059")]


def test_stix_families_runs(spark, tmp_path):
    ref = [{"source_name": "m", "external_id": "T1016.001"}]
    bundle = {"objects": [
        {"type": "attack-pattern", "id": "p1", "description": "use <code>ipconfig /all</code> and `word`", "external_references": ref}, {"type": "relationship", "relationship_type": "uses", "target_ref": "p1", "description": "ran `arp -a`"},
        {"type": "relationship", "relationship_type": "uses", "target_ref": "other", "description": "`net view`"}, {"type": "malware", "id": "m", "description": "`x y`"},
    ]}
    assert {tuple(r) for r in corpora.stix_commands(spark, put(tmp_path, "b.json", json.dumps(bundle))).collect()} == {("ipconfig /all", "T1016"), ("arp -a", "T1016")}
    p = spark.createDataFrame([("T1", ["a", "b", "zz"], False), ("T1", ["a"], None), ("T2", ["a"], True)], "technique string, phases array<string>, deprecated boolean")
    assert [(r.technique, r.families) for r in corpora.technique_families(p, {"a": "A", "b": "B"}).collect()] == [("T1", ["A", "B"])]
    put(tmp_path, "runs/x/e.json", '{"metrics": {"f1": 1}}')
    put(tmp_path, "runs/y/bad.json", "{")
    put(tmp_path, "runs/t.json", '{"training_manifest": "a"}')
    assert sorted(r.kind for r in corpora.run_metadata(spark, str(tmp_path / "runs")).collect()) == ["evaluation", "training"]


def test_writers_and_audit(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b",\nc', "train"), (2, "d", "train"), (2, "d", "test")], "k int, text string, split string")
    out = str(tmp_path / "out")
    outputs.write_rows(df, out, "csv")
    with pytest.raises(Exception, match="already exists"):
        outputs.write_rows(df, out, "csv")
    assert corpora.read_rows(spark, out + "/*.csv", "k int, text string, split string").count() == 3
    stored = outputs.manifest(spark, out, "*.csv").withColumn("sha256", F.when(F.lit(True), "old"))
    got = {(r.problem, r.subject) for r in outputs.audit(spark, out, stored, df, "k", "split", ["train", "test", "validation"]).collect()}
    assert ("empty split", "validation") in got and ("shared keys", "test/train: 1") in got and any(p == "changed" for p, _ in got)
    p = spark.createDataFrame([(1, [0.2, 0.9], [0, 1])], "k int, p array<double>, t array<int>")
    assert outputs.predictions(p, "k", "p", "t", ["a", "b"], 0.5).first().selected == ["b"]
