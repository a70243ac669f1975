"""Near-duplicate components against brute force."""

import random

import pytest

from cmdlake.llm import near_dedup


def brute(rows, share=85):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= share * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least[root(i)], d == least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def found(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n int, c int")
    return sorted(tuple(x)[:4] for x in near_dedup.near_components(docs, **options).collect())


def groups(r, sizes, lengths, edits):
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(6):
        base = r.choices(words, k=r.choice(lengths))
        for _ in range(r.choice(sizes)):
            w = list(base)
            for _ in range(r.randint(0, max(1, int(len(w) * edits)))):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "short", "share"), [(1, 24, 85), (2, 3, 85), (3, 2, 80), (4, 24, 80)])
def test_components(spark, seed, short, share):
    r = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "one two three")] + groups(r, [1, 3, 25], [12, 40, 150], 0.025)
    r.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)] + [rows[3]]
    # rows that repeat a doc_id share the smallest component any of them has only if their sets agree
    assert found(spark, rows, share=share, short_list=short) == sorted(brute(rows, share))


@pytest.mark.parametrize("share", [85, 80])
def test_common_passage_and_large_group(spark, share):
    """Long lists: a passage in many texts, one group of many near copies of one base, and growing texts."""
    r = random.Random(share)
    words = [f"w{i}" for i in range(5000)]
    passage, base = r.choices(words, k=60), r.choices(words, k=150)
    texts = [" ".join(r.choices(words, k=r.randint(20, 90)) + passage + r.choices(words, k=r.randint(0, 30))) for _ in range(80)]
    for _ in range(120):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(" ".join(w[: r.randint(130, 150)]))
    texts += [" ".join(base[: 40 + 6 * i]) for i in range(18)] + [" ".join(base)] * 5
    r.shuffle(texts)
    rows = list(enumerate(texts))
    assert found(spark, rows, share=share) == sorted(brute(rows, share))


def test_null_ids_and_long_text(spark):
    r = random.Random(9)
    long_ = " ".join(f"x{r.randrange(10**6)}" for _ in range(60_000))
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (7, "a b c d e f g"), (None, "only nulls hold these words here"), (5, long_), (3, long_ + " tail"), (4, long_[::-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(repr, (tuple(x)[:4] for x in near_dedup.near_components(docs).collect())))
    n = len({tuple(long_.split()[i : i + 5]) for i in range(59_996)})
    want = [(None, 3, 7, False)] * 2 + [(7, 3, 7, True), (None, 2, None, True), (5, n, 3, False), (3, n + 1, 3, True), (4, n, 4, True)]
    assert got == sorted(map(repr, want))


def test_patterned_words_are_told_apart(spark):
    """Thue-Morse words, for which a plain polynomial modulo a power of two gives equal hashes."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    assert found(spark, [(1, word), (2, other)]) == [(1, 1, 1, True), (2, 1, 2, True)]


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(i, t, i, "x", 1, 2) for i, t in enumerate(["a b c d e f"] * 3 + ["other words stand here now ok"])] + [(3, "other words stand here now ok", 3, "x", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, D int, row_hash string, `n` int, `__k` int")
    got = near_dedup.one_of_each(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [0, 3]


def test_empty_table(spark):
    assert near_dedup.near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
