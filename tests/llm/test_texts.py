"""Language, tokens, quality, counts, packing, media, archives and the pipeline on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from cmdlake.llm import bpe_chunks, langid, mpeg_audio, packing, quality, token_counts, vocab, warc
from cmdlake.llm.vocab import default_path

TEXTS = [None, "", " ", "a", "Hello, WORLD! it's 2024", "naïve café ÀÉ", "日本語 テスト", "<|endoftext|> x", "tab\there\x0b\x1c\x85\xa0", "é combining", "word " * 700, "x" * 5000, "İstanbul", "a\0b", "word " * 700]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 3 else i, t, "en", "clash", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, piece string, n_tokens int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def library():
    t = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_vocab_agrees_with_library():
    r, v, t = random.Random(3), vocab.word_vocab(default_path("word_bpe_49k.json")), library()
    letters = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(32, 127), *range(0xC0, 0x180)]]
    texts = ["".join(r.choices(letters, k=r.randint(0, 50))) for _ in range(3000)] + [x or "" for x in TEXTS]
    assert v.ids_of(texts) == [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


def test_bpe(docs, empty):
    t = library()
    want = []
    for i, x in enumerate(TEXTS):
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((None if i == 3 else i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, bpe_chunks.encode_decode(docs).collect()))) == sorted(map(repr, want))
    assert bpe_chunks.encode_decode(empty).count() == 0


def test_chunks_are_by_content_and_joins_agree():
    r = random.Random(4)
    words = ["the", "of", "unbelievable", "it's", "12", "--", "naïve"] + ["".join(r.choices("abcdefgh", k=9)) for _ in range(200)]
    shared = " ".join(r.choices(words, k=800))
    texts = [" ".join(r.choices(words, k=r.randint(1, 300))) + " " + shared + r.choice(["", " ", "x"]) for _ in range(20)]
    v = vocab.word_vocab(default_path("word_bpe_49k.json"))
    e = bpe_chunks.ChunkEncoder(v)
    assert e.encode(texts) == v.ids_of(texts)
    parts = Counter(t[a:b] for t in texts for ends in [bpe_chunks.chunk_ends(t)] for a, b in zip([0, *ends[:-1]], ends, strict=True))
    assert max(parts.values()) >= 15


def test_token_counts(docs, empty):
    lengths = [len(library().encode(x or "", add_special_tokens=False).ids) for x in TEXTS]
    got = {r.context_limit: r for r in token_counts.length_histogram(docs).collect()}
    assert set(got) == set(lengths)
    for limit, r in got.items():
        assert r.n_docs == lengths.count(limit) and r.n_docs_longer == sum(n > limit for n in lengths)
        assert r.total_tokens == sum(lengths) and r.truncated_tokens == sum(min(n, limit) for n in lengths)
        assert math.isclose(r.share_whole, sum(n <= limit for n in lengths) / len(lengths))
    assert token_counts.length_histogram(empty).count() == 0


def check_packed(rows, texts, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.ids_crc32 if r.doc_id is None else 0), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


def test_packing(docs, empty):
    rows = packing.pack_documents(docs).collect()
    t, want = library(), []
    for i, x in enumerate(TEXTS):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want.append((None if i == 3 else i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(repr(tuple(r)[:5]) for r in rows) == sorted(map(repr, want))
    used = check_packed(rows, TEXTS, 2048)
    assert used <= math.ceil(sum(w[3] for w in want) / 2048) + 1
    assert packing.pack_documents(empty).count() == 0


def test_packing_is_close_to_the_bound():
    for seed in range(100):
        r = random.Random(seed)
        capacity = r.choice([10, 50, 2048])
        counts = Counter(r.randint(1, capacity - 1) for _ in range(r.randint(0, 300)))
        fixed, rest = packing.dominant_sets(dict(counts), capacity)
        packed = fixed + packing.best_fit(rest, capacity)
        got = Counter()
        for pattern, times in packed:
            assert sum(n * each for n, each in pattern) <= capacity and times > 0
            for n, each in pattern:
                got[n] += times * each
        assert got == counts
        total = sum(n * c for n, c in counts.items())
        assert sum(t for _, t in packed) <= 11 / 9 * max(math.ceil(total / capacity), sum(c for n, c in counts.items() if 2 * n > capacity)) + 1


def test_media(docs, empty):
    got = mpeg_audio.read_media(mpeg_audio.encode_media(docs)).collect()
    for r, x in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), [*(x for i, x in enumerate(TEXTS) if i != 3), TEXTS[3]], strict=True):
        raw = (x or "").encode()
        padded = raw + b" " * (-len(raw) % 192 or 192 * (not raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r.bad_frames == 0 and r.resyncs == 0 and f"frames={len(range(0, len(padded), 576))}" in r.feature
    assert mpeg_audio.read_media(mpeg_audio.encode_media(empty)).count() == 0


def test_media_damage():
    payload = bytes(range(32, 122)) * 64
    media = mpeg_audio.encode(payload, len(payload))
    whole = mpeg_audio.parse(media)
    assert whole["payload"] == payload and whole["table"]["frames"] == len(whole["offsets"]) and whole["samples"] == 1152 * len(whole["offsets"])
    at = whole["offsets"][2]
    flipped = media[: at + 10] + bytes([media[at + 10] ^ 1]) + media[at + 11 :]
    assert mpeg_audio.parse(flipped)["bad_frames"] == 1
    torn = mpeg_audio.parse(media[: at + 20] + b"\xff\xfa\x00" + media[whole["offsets"][3] :])
    assert torn["resyncs"] > 0 and len(torn["offsets"]) == len(whole["offsets"]) - 1
    assert mpeg_audio.parse(b"")["offsets"] == [] and mpeg_audio.parse(b"junk" * 9)["payload"] == b""


def test_warc(spark):
    rows = [(5, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (9, None, None), (4, "http://c c\r\n", ""), (None, "http://d/", "<p>é</p>"), (7, "u", "x" * 300000), (2, "http://b/", "<p>é</p>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, first_id string")
    got = warc.read_archives(warc.write_archives(pages)).collect()
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == Counter({("5", "revisit", "2"): 1, ("2", "response", None): 2, ("9", "revisit", "4"): 1, ("4", "response", None): 1, (None, "revisit", "2"): 1, ("7", "response", None): 1})
    for r in got:
        if r.record_type == "response":
            assert r.payload_bytes == len(r.payload.encode()) and r.payload_digest == warc.digest(r.payload.encode())
    assert {r.payload_bytes for r in got if r.page_id == "5"} == {len("<p>é</p>".encode())}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    content = warc.member([("WARC-Type", "response")], b"abc") * 2
    assert [warc.record(x)[1] for x in warc.members(content, 7)] == [b"abc", b"abc"]


def brute_quality(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, docs, empty):
    r = random.Random(5)
    extra = ["\n".join(r.choices(["a b c d e f", "x #y", "", "q w e r t", "\xa0 z"], k=12)) for _ in range(30)]
    more = spark.createDataFrame(list(enumerate(extra, 100)), "doc_id long, text string")
    got = {x.doc_id: x for x in quality.quality(docs.select("doc_id", "text").union(more)).collect() if x.doc_id is not None}
    for i, t in [*enumerate(TEXTS), *enumerate(extra, 100)]:
        if i != 3:
            x = got[i]
            n, chars, symbols, dup, rep = brute_quality(t)
            assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (n, chars, symbols, dup, rep)
            assert x.base_failed == (n < 10 or 100 * rep > 20 * n) and (not x.base_failed or not x.kept)
    assert quality.quality(empty).count() == 0


def test_quality_bands(spark):
    r = random.Random(7)
    noise = lambda signs, n: " ".join("".join(r.choices(signs, k=6)) for _ in range(n))
    clean = {
        "latin": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another.",
        "cyrillic": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в духе братства.",
        "greek": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση.",
        "devanagari": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है।",
        "hangul": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 행동하여야 한다.",
    }
    signs = ["abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz0123456789", "!@#$%^&*()-_=+;:,.<>/?|~", "абвгдежзиклмнопрстуфхцчшыья", "αβγδεζηθικλμνξοπρστυφχψω", "कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह"]
    bad = [noise(s, n) for s in signs for n in (10, 12, 40, 300)]
    bad += [" ".join(w + r.choice(("***", "$$$", "%%%", "&&&", "###")) for w in t.split()) for t in list(clean.values())[:2]]
    rows = [(k, t) for k, t in enumerate([*clean.values(), *bad])]
    got = {x.doc_id: x for x in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].script for k in range(len(clean))] == list(clean)
    assert all(got[k].kept for k in range(len(clean)))
    assert all(not got[k].base_failed for k, _ in rows)
    assert [t for k, t in rows[len(clean) :] if got[k].kept] == []


def test_quality_labelled(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.quality(spark.read.parquet(f"{sf}/documents.parquet")).filter("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    kept = {(x.quality, x.kept): x["count"] for x in rows.groupBy("quality", "kept").count().collect()}
    assert kept.get((1, False), 0) == 0 and kept[0, False] > 9 * kept.get((0, True), 0)


def test_language(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(d.filter("doc_id % 3 <> 1").select("text", "lang"))
    held = langid.identify(d.filter("doc_id % 3 = 1"), model).join(d.select("doc_id", "lang"), "doc_id")
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count()
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    assert (model["w"] == 0).mean() > 0.5
    assert langid.train(empty.select("text", "lang")) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


def test_pipeline(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf).cache()
        assert after.columns == columns
        assert 0 < after.count() <= docs.count(), name
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).cache()
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0


def test_words_are_tested_together_and_kept_ones_not_merged_again(monkeypatch):
    from cmdlake.llm import vocab

    v = vocab.WordVocab(vocab.default_path("word_bpe_49k.json"))
    tested, merged, plain, merge = [], [], v.plain, v._merge
    monkeypatch.setattr(v, "plain", lambda t: tested.append(t) or plain(t))
    monkeypatch.setattr(v, "_merge", lambda new: merged.extend(new) or merge(new))
    monkeypatch.setattr(vocab, "CACHE_WORDS", 6)
    v.learn({"alpha", "beta", "gamma's", "d3lta"})
    v.learn({"alpha", "beta", "epsilon", "zeta", "eta"})
    assert len(tested) == 2 and sorted(merged) == sorted({"alpha", "beta", "gamma's", "d3lta", "epsilon", "zeta", "eta"})
    assert set(v.id_words) == {"alpha", "beta", "epsilon", "zeta", "eta"}
    for text in ("Alpha BETA x", "Ünï Ω alpha Beta [UNK] eta", "Ω Beta BETA", ""):
        assert v.ids(text) == np.array(v.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
