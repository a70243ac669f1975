"""Both repeat removers against brute force over small texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cmdlake.llm import repeats, substring_dedup, suffix_dedup


def brute(seqs, width):
    seen = Counter(tuple(s[i : i + width]) for s in seqs for i in range(len(s) - width + 1))
    out = []
    for s in seqs:
        away = [False] * len(s)
        for i in range(len(s) - width + 1):
            if seen[tuple(s[i : i + width])] > 1:
                away[i : i + width] = [True] * width
        out.append(away)
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["the", "of", "é", "x", "run", "stone", "river", "and", "#", "a1"] + [f"w{i}" for i in range(60)]
    passage = [" ".join(r.choices(words, k=n)) for n in (12, 30, 9)]
    texts = [None, "", " ", "same " * 40, "same " * 40, "a"]
    for _ in range(40):
        parts = [" ".join(r.choices(words, k=r.randint(0, 30))) for _ in range(3)]
        parts.insert(r.randint(0, 3), r.choice(passage))
        texts.append((" " if r.random() < 0.5 else "\n").join(parts))
    return texts + texts[10:13]


@pytest.mark.parametrize(("seed", "crowded"), [(1, 2000), (2, 2)])
def test_bytes(spark, seed, crowded, monkeypatch):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    monkeypatch.setattr(repeats.repeated_windows, "__defaults__", (crowded, 500))
    texts = corpus(seed)
    rows = [(None if i == 7 else i, t, "clash") for i, t in enumerate(texts)] + [(20, texts[20], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, 30, 6).collect())
    raw = [(t or "").encode() for _, t, _ in rows]
    want = []
    for (i, _, _), s, away in zip(rows, raw, brute(raw, 30), strict=True):
        kept = bytes(b for b, x in zip(s, away, strict=True) if not x)
        spans = len(repeats.true_runs(np.array(away, bool))) if away else 0
        want.append((i is None, i or 0, len(s), sum(away), spans, hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want)


@pytest.mark.parametrize(("seed", "crowded"), [(3, 2000), (4, 2)])
def test_words(spark, seed, crowded, monkeypatch):
    monkeypatch.setattr(repeats.repeated_windows, "__defaults__", (crowded, 200))
    rows = list(enumerate(corpus(seed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, 8, 3).collect())
    raw = [(t or "").encode().split() for _, t in rows]
    want = [
        (i, len(s), sum(away), hashlib.sha256(b" ".join(w for w, x in zip(s, away, strict=True) if not x)).hexdigest())
        for (i, _), s, away in zip(rows, raw, brute(raw, 8), strict=True)
    ]
    assert got == sorted(want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(docs).count() == 0
    assert substring_dedup.remove_repeats(docs).count() == 0


def test_blocks_cover_every_window_once():
    raw = [b"ab" * 9, b"", b"abcabcabcd" * 5, b"x"]
    symbols, starts = repeats.byte_symbols(raw)
    text, at, n, h = repeats.runs(symbols, starts, 10, 3, block=7)[:4]
    got = sorted((t, a + i) for t, a, k in zip(text, at, n, strict=True) for i in range(k))
    assert got == [(t, i) for t, s in enumerate(raw) for i in range(len(s) - 9)]
    whole = repeats.runs(symbols, starts, 10, 3)
    named = {(t, a + i): x for t, a, k, x in zip(text, at, n, h, strict=True) for i in range(k)}
    assert named == {(t, a + i): x for t, a, k, x in zip(*whole[:4], strict=True) for i in range(k)}
