"""Spelling variants against brute force."""

import random
import re
import zlib

import pytest

from cmdlake.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def edits(w, letters):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))}
    out |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
    return out - {w}


def brute(rows):
    counts = {}
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    vocab = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    letters = {c for w in vocab for c in w}
    near = {w: [x for x in edits(w, letters) if x in vocab] for w in vocab}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best is not None and vocab[best] >= 2 * vocab[w] else None
    out = []
    for w, n in vocab.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], vocab.get(form[w]), root))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, n int, word string, key int")
    return sorted((tuple(x) for x in spelling.variants(docs, **options).collect()), key=repr)


@pytest.mark.parametrize(("seed", "crowded"), [(1, 64), (2, 2), (3, 5)])
def test_variants(spark, seed, crowded):
    r = random.Random(seed)
    base = ["".join(r.choices("abé", k=r.choice([5, 6, 7, 12]))) for _ in range(60)] + ["prefixed" + "".join(r.choices("xyzÿ", k=3)) for _ in range(40)] + ["a" * n for n in (5, 6, 7, 40)]
    rows = []
    for i in range(400):
        w = r.choice(base)
        if r.random() < 0.3:
            w = r.choice(sorted(edits(w, "abx")))
        rows.append((i if i % 50 else None, " ".join([w.upper() if r.random() < 0.2 else w] * r.randint(1, 40))))
    rows += [(900, None), (901, ""), (902, "12 × ÷ 34"), (903, "ab cd " * 2000), rows[5], (-7, "Straße ÄRGER ärger aérger " * 9)]
    got = found(spark, rows, crowded=crowded)
    assert got == brute(rows)
    assert any(x[3] for x in got) and any(x[5] not in (x[0], x[3]) for x in got)


def test_chains_lead_to_the_last(spark):
    rows = [(1, " ".join(["abcde"] * 3 + ["abcdf"] * 7 + ["abcgf"] * 15 + ["abhgf"] * 31 + ["aihgf"] * 70 + ["jihgf"] * 150))]
    assert {x[5] for x in found(spark, rows)} >= {"jihgf"} and found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == [] and found(spark, [(1, "one two")]) == []


def test_given_documents(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(x) for x in queries.op13_spelling(spark, SF).collect()), key=repr) == brute(rows)
