"""What the queries promise: odd ids, hostile bytes, column types, and each pipeline stage against brute force."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cmdlake.llm import bpe_chunks, langid, mpeg_audio, packing, queries, substring_dedup, suffix_dedup, token_counts, vocab, warc

BIG = 1152921504606846977
SF = "/root/testdata/sf0.001"
TYPES = {
    "op1_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op2_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op3_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op5_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op6_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op7_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op9_mpeg_audio": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op10_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
}


@pytest.mark.parametrize("name", TYPES)
def test_columns_and_rows(spark, name):
    got = queries.queries()[name](spark, SF).cache()
    kinds = dict(got.dtypes)
    assert all(kinds[c] == kind for c, kind in (x.rsplit(" ", 1) for x in TYPES[name].split(", ")))
    table, key = ("pages", "page_id") if name == "op7_warc" else ("documents", "doc_id")
    there = spark.read.parquet(f"{SF}/{table}.parquet")
    rows = got.filter("piece = 0") if name == "op10_packing" else got
    assert rows.count() == there.count() and rows.select(key).exceptAll(there.select(key)).count() == 0


def test_held_out_rule(spark):
    import zlib

    got = queries.op3_language_id(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got) and len({r.held_out for r in got}) == 2


def test_large_ids_beside_nulls(spark):
    rows = [(None, "a b"), (BIG, "a c"), (BIG + 2, None), (None, None)]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, key string, piece int")
    for found in (bpe_chunks.encode_decode(docs), packing.pack_documents(docs), mpeg_audio.read_media(mpeg_audio.encode_media(docs)), langid.identify(docs, None), suffix_dedup.remove_repeats(docs), substring_dedup.remove_repeats(docs)):
        assert Counter(r.doc_id for r in found.collect()) == Counter({None: 2, BIG: 1, BIG + 2: 1})


def test_archives_with_large_ids(spark):
    pages = spark.createDataFrame([(BIG, "u", "same"), (BIG + 2, "u", "same"), (None, "u", "x"), (3, None, "é" * 70000), (4, None, None)], "page_id long, url string, html string")
    archives = warc.write_archives(pages).cache()
    got = {r.page_id: r for r in warc.read_archives(archives).collect()}
    assert (got[str(BIG)].record_type, got[str(BIG)].refers_to) == ("response", None)
    assert (got[str(BIG + 2)].record_type, got[str(BIG + 2)].refers_to) == ("revisit", str(BIG))
    assert got[None].record_type == "response" and got["3"].payload_bytes == 140000 and got["4"].payload_bytes == 0
    fields = [warc.record(x)[0] for r in archives.collect() for x in warc.members(bytes(r.content))]
    ids = {f["WARC-Record-ID"]: f["WARC-Type"] for f in fields}
    assert [ids[f["WARC-Refers-To"]] for f in fields if "WARC-Refers-To" in f] == ["response"]
    small = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    assert [r.record_type for r in warc.read_archives(warc.write_archives(small, least=3)).collect()] == ["response"] * 2


def test_archives_tell_damage(spark):
    fields = [("WARC-Type", "response"), ("WARC-Block-Digest", "sha1:" + warc.digest(b"abc"))]
    whole = warc.member(fields, b"abc")
    with pytest.raises(ValueError):
        list(warc.members(whole[:-9]))
    with pytest.raises(ValueError):
        warc.record(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nabc\r\n\r\n")
    bad = spark.createDataFrame([("a", warc.member([("WARC-Type", "response"), ("WARC-Block-Digest", "sha1:no"), ("WARC-Payload-Digest", "x"), ("WARC-Page-ID", "urn:page:1"), ("WARC-Target-URI", "u")], b"h: 1\r\n\r\nb"))], "archive string, content binary")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archives(bad).collect()


@pytest.mark.parametrize("units", [1, 2, 3, 4, 7])
@pytest.mark.parametrize("sign", [b"TAG", b"ID3\4\0\0\0\0\0\1", b"\xff\xfa\x64\xc0", b"Xing\0\0\0\7", b"VBRI"])
def test_media_with_signs_inside(units, sign):
    n = 192 * units
    for at in range(n - 192, n - len(sign) + 1):
        payload = b"a" * at + sign + b"b" * (n - at - len(sign))
        x = mpeg_audio.parse(mpeg_audio.encode(payload, n))
        assert x["payload"] == payload and x["n_bytes"] == n and x["bad_frames"] == x["resyncs"] == 0


def test_media_tags_tables_and_versions():
    payload = bytes(range(256)) * 9
    media = mpeg_audio.encode(payload, len(payload))
    tagged = mpeg_audio.parse(media + b"TAG" + bytes(125))
    assert tagged["payload"] == payload and tagged["resyncs"] == 0
    whole = mpeg_audio.parse(media)
    assert len(whole["table"]["seek"]) == 100 and whole["seek_drift"] <= max(b - a for a, b in zip(whole["offsets"], whole["offsets"][1:])) + len(media) / 256
    # MPEG-2 layer III, MPEG-2.5 layer III, MPEG-1 layers I and II: size, Hz and samples by the format's rules
    for head, want in ((b"\xff\xf3\x44\xc0", (96, 24000, False, 9, 576)), (b"\xff\xe3\x40\xc0", (208, 11025, False, 9, 576)), (b"\xff\xff\x44\xc0", (128, 48000, False, 0, 384)), (b"\xff\xfd\x44\xc0", (192, 48000, False, 0, 1152))):
        assert mpeg_audio.header(head) == want
        x = mpeg_audio.parse((head + bytes(want[0] - 4)) * 5)
        assert (len(x["offsets"]), x["samples"], x["rate"]) == (5, 5 * want[4], want[1])
    vbri = (b"\xff\xfb\x64\xc0" + bytes(32) + b"VBRI" + bytes(6) + (900).to_bytes(4) + (3).to_bytes(4) + (2).to_bytes(2) + (1).to_bytes(2) + (2).to_bytes(2) + (1).to_bytes(2) + (240).to_bytes(2) + (240).to_bytes(2)).ljust(mpeg_audio.header(b"\xff\xfb\x64\xc0")[0], b"\0")
    assert mpeg_audio.parse(vbri + (b"\xff\xfb\x64\xc0" + bytes(mpeg_audio.header(b"\xff\xfb\x64\xc0")[0] - 4)) * 3)["table"] == {"frames": 3, "bytes": 900, "seek": [0, 240]}


def test_patterned_words(spark):
    """34 shared words and one of two words that a plain polynomial hash modulo 2**64 can't tell apart."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    shared = " ".join(f"s{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{shared} {word}"), (2, f"{shared} {word.translate(str.maketrans('ab', 'ba'))}")], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(docs).collect()] == [0, 0]


def test_long_text_loses_its_repeats(spark):
    r = random.Random(1)
    words = [f"x{r.randrange(10**7)}" for _ in range(40_000)]
    passage = " ".join(words[500:600])
    docs = spark.createDataFrame([(1, " ".join(words)), (2, f"other {passage} end")], "doc_id long, text string")
    got = {x.doc_id: x for x in suffix_dedup.remove_repeats(docs).collect()}
    assert got[1].n_removed == got[2].n_removed == len(f" {passage} ") and got[1].n_spans == 1
    assert {x.doc_id: x.n_removed for x in substring_dedup.remove_repeats(docs).collect()} == {1: 100, 2: 100}


def test_any_limit_and_quantile(spark):
    texts = [None, "", "a", "a b c", "a b c d e", "a b c d e", "z " * 300]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    hist = token_counts.length_histogram(docs).cache()
    lengths = sorted(len(x) // 4 for x in vocab.word_vocab(vocab.default_path("word_bpe_49k.json")).ids_of(texts))
    for r in token_counts.at_limits(hist, [0, 1, 2, 4, 5, 100, 10**6]).collect():
        assert (r.n_docs_longer, r.total_tokens, r.truncated_tokens) == (sum(n > r.context_limit for n in lengths), sum(lengths), sum(min(n, r.context_limit) for n in lengths))
    assert [token_counts.quantile(hist, q).first()[0] for q in (0.1, 0.5, 1.0)] == [lengths[0], lengths[3], lengths[-1]]


def test_ftrl_fits_like_an_independent_loop():
    """One epoch over separable rows: the sparse update agrees with a dense one written from the formulas."""
    rows = [((np.array([1, 5]), np.array([0.5, 0.5])), "a"), ((np.array([2, 5]), np.array([0.7, 0.3])), "b")] * 3
    model = langid.fit(rows, alpha=0.5, beta=1.0, l1=0.02, l2=0.02, epochs=1)
    df = Counter(f for (fs, _), _ in rows for f in fs.tolist())
    idf = {f: np.log((1 + len(rows)) / (1 + n)) + 1 for f, n in df.items()}
    z, n, b = ({(f, k): 0.0 for f in df for k in (0, 1)} for _ in range(3))
    b = [0.0, 0.0]
    weight = lambda f, k: 0.0 if abs(z[f, k]) <= 0.02 else -(z[f, k] - np.sign(z[f, k]) * 0.02) / ((1 + n[f, k] ** 0.5) / 0.5 + 0.02)
    for i in np.random.default_rng(7).permutation(np.arange(len(rows))):
        (fs, tf), lang = rows[i]
        x = {f: t * idf[f] * langid.SCALE for f, t in zip(fs.tolist(), tf.tolist())}
        w = {(f, k): weight(f, k) for f in x for k in (0, 1)}
        s = [sum(x[f] * w[f, k] for f in x) + b[k] for k in (0, 1)]
        p = np.exp(s - np.max(s)) / np.exp(s - np.max(s)).sum()
        for k in (0, 1):
            g = p[k] - (k == (lang == "b"))
            for f in x:
                z[f, k] += g * x[f] - ((n[f, k] + (g * x[f]) ** 2) ** 0.5 - n[f, k] ** 0.5) / 0.5 * w[f, k]
                n[f, k] += (g * x[f]) ** 2
            b[k] -= 0.02 * g
    for f in df:
        for k in (0, 1):
            assert abs(model["w"][f, k] - weight(f, k) * idf[f] * langid.SCALE) < 1e-3
    assert np.allclose(model["bias"], b)


def brute_components(texts, share):
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= share * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    return comp


def test_pipeline_stages_by_brute_force(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("X", F.lit(json.dumps({"clash": 1})))
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text for r in rows}
    near = {r.doc_id for r in stages["near_dedup"](spark, docs, SF).collect()}
    comp = brute_components([r.text for r in rows], 80)
    assert near == {r.doc_id for i, r in enumerate(rows) if comp[i] == i}
    left = stages["suffix_dedup"](spark, docs, SF).collect()
    seen = Counter(t.encode()[i : i + 200] for t in texts.values() for i in range(len(t.encode()) - 199))
    for r in left:
        raw = texts[r.doc_id].encode()
        away = np.zeros(len(raw), bool)
        for i in range(len(raw) - 199):
            if seen[raw[i : i + 200]] > 1:
                away[i : i + 200] = True
        assert r.text == np.frombuffer(raw, "u1")[~away].tobytes().decode("utf-8", "ignore") and r.n_chars == len(r.text)
    judged = {r.doc_id: r.kept for r in queries.op5_quality(spark, SF).collect()}
    assert {r.doc_id for r in stages["quality_rules"](spark, docs, SF).collect()} == {d for d, ok in judged.items() if ok}
    model = langid.train(docs.select("text", "lang"))
    lang, score = langid.verdicts([r.text for r in rows], model)
    assert {r.doc_id for r in stages["language_id"](spark, docs, SF).collect()} == {r.doc_id for r, x, s in zip(rows, lang, score) if x != "und" and s >= corpus_pipeline.LEAST_SCORE}


def test_pipeline_keeps_null_columns_and_empty_tables(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (None, "word " * 3, None, "s", 15)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= max(3, docs.count()), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(packed) == 3 and hashlib.sha256(b"").hexdigest()  # a piece for each row, null and empty ones too


def test_numbers_are_no_letters_and_copies_count_once(spark):
    """Text without a letter is undetermined; a text that repeats a thousand times is drawn once."""
    rows = [(f"the cat number {i} sat there", "en") for i in range(60)] + [(f"le chat numero {i} est ici", "fr") for i in range(60)] + [("the same again", "en")] * 1000
    seen = []
    model = langid.fit
    try:
        langid.fit = lambda rows: seen.extend(rows) or model(rows)
        fitted = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    finally:
        langid.fit = model
    assert len(seen) <= 121
    assert langid.verdicts(["½ ²", "Ⅷ ① ३", "12 34", "a", "字"], fitted)[0][:3] == ["und"] * 3
    assert "und" not in langid.verdicts(["the ½", "字"], fitted)[0]
