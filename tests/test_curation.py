"""Curation operators on small rows where the answer is known."""

import pytest
from pyspark.sql import functions as F

from cmdlake.operators import curation


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'array<double>' if isinstance(v, list) else 'string'}" for k, v in values.items())).select(column.alias("x")).first().x


def test_cleaning(spark):
    cases = {"$ ls {{path/to/file}}": "ls path/to/file", "PS C:\\> get-item #{name:x}": "get-item $name", "| a | b |": None, "- item": None, "1234": None, "x": None, " a \t b ": "a b", None: None, "y" * 2049: None}
    for line, want in cases.items():
        df = spark.createDataFrame([(line,)], "c string")
        assert df.select(curation.cleaned_command(F.col("c")).alias("x")).first().x == want, line


def test_soft_targets_out_of_range_fail(spark):
    t = curation.two_way_target(F.col("a"), F.col("b"), F.col("c"))
    assert one(spark, t, a=0.5, b=0.25, c=0.25) == (0.5, 0.5, 0.25)
    for bad in ((0.0, 0.0, 0.0), (1.5, 0.0, 0.0)):
        with pytest.raises(Exception, match="out of range"):
            one(spark, t, a=bad[0], b=bad[1], c=bad[2])


def test_views_and_top_two(spark):
    assert one(spark, curation.fused(F.col("p"), F.col("r"), "mean"), p=[0.5, 0.5], r=[1.0, 0.0]) == [0.75, 0.25]
    assert one(spark, curation.fused(F.col("p"), F.col("r"), "raw"), p=[0.5, 0.5], r=[1.0, 0.0]) == [1.0, 0.0]
    with pytest.raises(ValueError):
        curation.fused(F.col("p"), F.col("r"), "other")
    got = one(spark, curation.top_two(F.col("p"), ["Benign", "Malicious", "Context"]), p=[0.3, 0.3, 0.4])
    assert (got.label, got.second_label, round(got.decision_margin, 6)) == ("Context", "Benign", 0.1)


def test_ratio_deficits():
    want = {"Benign": 0, "Malicious": 15, "Context": 10}
    assert curation.ratio_deficits({"Benign": 60, "Malicious": 10, "Context": 5}, {"Benign": 0.6, "Malicious": 0.25, "Context": 0.15}, "Benign") == want
    with pytest.raises(ValueError):
        curation.ratio_deficits({"a": 1}, {"a": 0.5}, "a")


def test_review_cells(spark):
    cases = {'["a", "b;c"]': ["a", "b;c"], " x ; ;y": ["x", "y"], "None": None, "": None, "null": None, None: None}
    for cell, want in cases.items():
        assert spark.createDataFrame([(cell,)], "c string").select(curation.cell_list(F.col("c")).alias("x")).first().x == want


def test_no_weak_predicate_is_constant(spark):
    from cmdlake.plans import curation_queries

    rows = curation_queries.QUERIES["dst1_predicates"](spark, "/root/testdata/sf0.001").drop("event_id")
    sums = rows.agg(*[F.sum(F.col(c).cast("int")).alias(c) for c in rows.columns]).first().asDict()
    assert [c for c, n in sums.items() if not 0 < n < 1000] == []


def test_signatures_mask_what_varies(spark):
    from cmdlake.operators import triage

    commands = ["curl -o C:\\Temp\\a1.exe http://10.0.0.1/x", "curl -o C:\\Temp\\b2.exe http://10.0.0.2/y", "run job 17 0xff --depth 3", "   "]
    rows = triage.parse_commands(spark.createDataFrame([(c,) for c in commands], "command string")).select(triage.signature().alias("s")).collect()
    assert rows[0].s.typed_slots == ["<IP>", "<PATH:users_public>", "<URL>", "C:\\Temp\\a1.exe"] and rows[1].s.executable == "curl"
    assert rows[2].s.raw_signature == "run|*|depth,depth:3|<HEX>,<NUM>,job"
    assert rows[3].s.raw_signature.startswith("unknown|*|")


def test_manifest_tells_which_id_has_which_text(spark, tmp_path):
    import hashlib

    from cmdlake.plans import curation_queries

    def manifest(name, rows):
        spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        return {r.source: (r.n, r.digest) for r in curation_queries.QUERIES["snk3_manifest"](spark, f"{tmp_path}/{name}").collect()}

    d = lambda *texts: hashlib.sha256("".join(hashlib.sha256(t.encode()).hexdigest() for t in texts).encode()).hexdigest()
    rest = [(5, "b", None), (6, None, "x"), (8, None, "é"), (9, "c", ""), (7, "c", None)]
    got = manifest("one", [(10, "a", "p"), (2, "a", "q"), (3, "a", "p"), *rest])
    assert got == {"a": (3, d("q", "p", "p")), "b": (1, None), None: (2, d("x", "é")), "c": (2, d(""))}
    assert manifest("swapped", [(10, "a", "q"), (2, "a", "p"), (3, "a", "p"), *rest])["a"] == (3, d("p", "p", "q"))
