"""BPE encoding and decoding with content-defined chunks.

A rolling hash over characters places chunk ends by content, so passages that documents
share fall into the same chunks; a chunk is encoded once per Python worker while it stays in
a bounded cache.  A chunk end may fall inside a word.  Each join is then repaired: the
characters back to the last white space on its left and on to the first on its right are
encoded anew, together with the next word on either side.  If the ids of those two words come
out as the chunks have them, both sides agree and the repair ends; else the span widens to the
two chunks, and on over further ones, until the ids beyond it agree.  Joins are looked up by
the text that was encoded anew, so a repair too is done once while it stays cached.

Null text counts as empty: 0 ids, the digest of nothing.  Texts of any script and length take
this way, special tokens' strings included.  Repeated rows are encoded each, with equal values;
null ids are carried through; other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdlake.llm.common import chunks
from cmdlake.llm.vocab import WordVocab, default_path, word_vocab

#: Characters that a chunk end depends on, and the mean distance of ends (a power of two).
HASH_CHARS, MEAN_CHUNK = 16, 512
CACHE_CHUNKS, CACHE_JOINS = 50_000, 100_000
#: A chunk's first word, its inner text (from the first white space to the last) and its last word.
_EDGES = re.compile(r"([^\t-\r ]*)(?:([\t-\r ].*[\t-\r ]|[\t-\r ])([^\t-\r ]*))?", re.S)


def chunk_ends(text: str) -> list[int]:
    """Positions after which the rolling hash of the last HASH_CHARS characters ends a chunk."""
    code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype("u8")
    if len(code) <= HASH_CHARS:
        return [len(text)]
    rolled, span, base = code * np.uint64(0x9E3779B97F4A7C15), 1, 0x100000001B3
    while span < HASH_CHARS:  # hash of 2 * span characters from two of span
        rolled = rolled[:-span] * np.uint64(base) + rolled[span:]
        base = base * base % 2**64
        span *= 2
    found = (np.flatnonzero((rolled >> np.uint64(40)) % np.uint64(MEAN_CHUNK) == 0) + HASH_CHARS).tolist()
    return found if found and found[-1] == len(text) else [*found, len(text)]


class ChunkEncoder:
    def __init__(self, vocab: WordVocab) -> None:
        self.vocab = vocab
        #: chunk -> (first word, inner ids, last word, inner text's first and last word); no inner ids: one word alone.
        self.cache: dict[str, tuple[str, bytes | None, str, str, str]] = {}
        #: (word before, word that the join cuts, word after) -> its ids, or None if the neighbours' ids change.
        self.joins: dict[tuple[str, str, str], bytes | None] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = []
        for t in texts:
            ends = chunk_ends(t) if t else []
            cut.append([t[a:b] for a, b in pairwise([0, *ends])])
        self._learn_chunks({c for cs in cut for c in cs})
        spans = [self._parts(cs) for cs in cut]
        self._learn_joins({p for parts in spans for p in parts[::2]})
        return [self._whole(parts, t) for parts, t in zip(spans, texts, strict=True)]

    def _learn_chunks(self, found: set[str]) -> None:
        new = list(found - self.cache.keys())
        if len(self.cache) + len(new) > CACHE_CHUNKS:
            self.cache.clear()
            new = list(found)
        edges = [_EDGES.fullmatch(c).groups() for c in new]
        for c, (head, inner, tail), ids in zip(new, edges, self.vocab.ids_of([m for _, m, _ in edges]), strict=True):
            words = inner.split(None, 1) if inner else []
            last = inner.rsplit(None, 1)[-1] if words else ""
            self.cache[c] = (head, None if inner is None else ids, tail or "", words[0].rstrip() if words else "", last.lstrip())

    def _parts(self, cs: list[str]) -> list:
        """Joins (word before, cut word, word after) and inner ids of chunks in turn; joins come first and last."""
        parts: list = [("", "", "")]
        for c in cs:
            head, ids, tail, first, last = self.cache[c]
            before, word, _ = parts[-1]
            parts[-1] = (before, word + head, first)
            if ids is not None:
                parts += [ids, (last, tail, "")]
        return parts

    def _learn_joins(self, found: set[tuple[str, str, str]]) -> None:
        new = list(found - self.joins.keys())
        if len(self.joins) + len(new) > CACHE_JOINS:
            self.joins.clear()
            new = list(found)
        alone = [self.vocab.ids_of([x[k] for x in new]) for k in range(3)]
        together = self.vocab.slow.encode_batch([" ".join(x) for x in new], add_special_tokens=False) if new else []
        for x, before, word, after, whole in zip(new, *alone, together, strict=True):
            ids = np.array(whole.ids, "<u4").tobytes()
            agree = ids.startswith(before) and ids.endswith(after) and len(ids) >= len(before) + len(after)
            self.joins[x] = ids[len(before) : len(ids) - len(after)] if agree else None

    def _whole(self, parts: list, text: str | None) -> bytes:
        out = [self.joins[p] if i % 2 == 0 else p for i, p in enumerate(parts)]
        if any(p is None for p in out):  # the widest span: nothing is left beyond it that could differ
            return np.array(self.vocab.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(out)


@lru_cache(maxsize=4)
def chunk_encoder(path: str) -> ChunkEncoder:
    """One encoder with its caches per Python worker and vocabulary file."""
    return ChunkEncoder(word_vocab(path))


def encode_decode(docs: DataFrame, vocab_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with keep_ids also ids (binary) and decoded text."""
    kind = docs.schema["doc_id"].dataType
    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep_ids

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = chunk_encoder(vocab_path or default_path("word_bpe_49k.json"))
        for pdf in frames:
            texts, keys = pdf["text"].tolist(), pdf["doc_id"].tolist()
            for a, b in chunks(texts):
                ids = encoder.encode(texts[a:b])
                shown = [encoder.vocab.decode(x) for x in ids]
                out = {"doc_id": keys[a:b], "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in shown]}
                yield pd.DataFrame(out | ({"ids": ids, "decoded": [x.decode("utf-8", "replace") for x in shown]} if keep_ids else {}))

    # as strings, for pandas would make doubles of whole numbers beside a null
    done = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(encode, schema)
    return done.withColumn("doc_id", F.col("doc_id").cast(kind))
