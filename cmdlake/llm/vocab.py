"""Exact token ids of a word-end BPE vocabulary, by cached whitespace words.

A ``tokenizers`` JSON file whose pre-tokenizer never joins text across white space encodes
each whitespace word on its own, so ids of a text are the ids of its words in order.  Words in
a plain alphabet (ASCII and Latin letters without combining marks, where lower-casing and
NFC act on one character at a time) are merged by ``tiktoken`` over the same merge ranks, with
the byte 0 standing for the word end.  A word holding any other character, or a special
token's string, is encoded by the ``tokenizers`` library, once while it stays in the cache; in
texts with such words only the six ASCII white-space characters part words.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Words kept per Python worker before the cache starts anew; bounds memory, never results.
CACHE_WORDS, CACHE_CHARS = 120_000, 8_000_000
_PLAIN = re.compile(r"[\t-\r\x20-\x7eÀ-įı-ňŊ-ž]*\Z")
_WORD = re.compile(r"[^\t-\r ]+")
_PIECE = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^\sa-zß-öø-ž0-9]+"
)


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for the 256 bytes."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordVocab:
    def __init__(self, path: str) -> None:
        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        spec = json.load(open(path))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        first = vocab["".join(merges[0])]
        self.fast = (
            spec["model"].get("end_of_word_suffix") == "</w>"
            and first >= 512
            and all(vocab["".join(m)] == first + i for i, m in enumerate(merges))
        )
        self.shown = {i: t.encode() for t, i in self.slow.get_vocab(with_added_tokens=True).items()}
        if self.fast:
            to_byte = _byte_alphabet()
            ranks = {}
            for token, i in vocab.items():
                if token in self.special:
                    continue
                end = token.endswith("</w>") and len(token) > 4
                raw = bytes(to_byte[c] for c in (token[:-4] if end else token))
                ranks[raw + b"\0" * end] = i
            self.merge = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
            self.ends = np.zeros(max(self.shown) + 1, bool)
            self.ends[[i for raw, i in ranks.items() if len(raw) > 1 and raw[-1] == 0]] = True
        self.id_words: dict[str, bytes] = {}
        self.held = 0

    def plain(self, text: str) -> bool:
        """Whether the cached path gives the library's ids for this text."""
        return self.fast and _PLAIN.match(text) is not None and not any(s in text for s in self.special)

    def words(self, text: str) -> list[str]:
        """Cache keys of the text's words: lower case where that acts on one character at a time."""
        return text.lower().split() if self.plain(text) else _WORD.findall(text)

    def learn(self, words: set[str]) -> None:
        """Merge the words not cached yet, all in one call; words that aren't plain by the library."""
        new = list(words - self.id_words.keys())
        self.held += sum(map(len, new))
        if len(self.id_words) + len(new) > CACHE_WORDS or self.held > CACHE_CHARS:
            # what this call needs stays, so that frequent words aren't merged again
            self.id_words = {w: self.id_words[w] for w in words & self.id_words.keys()}
            self.held = sum(map(len, words))
        # one look at all of them first: white space between words makes none of them plain or other
        whole = " ".join(new)
        other = [] if self.plain(whole) else [w for w in new if not self.plain(w)]
        for w, found in zip(other, self.slow.encode_batch(other, add_special_tokens=False) if other else (), strict=True):
            self.id_words[w] = np.array(found.ids, "<u4").tobytes()
        new = [w for w in new if w not in self.id_words] if other else new
        # a plain word of mixed case can stand in a text that isn't plain
        low = {w: w.lower() for w in new if w != w.lower()} if other or whole != whole.lower() else {}
        new = list({low.get(w, w) for w in new} - self.id_words.keys()) if low else new
        if new:
            self._merge(new)
        for w, x in low.items():
            self.id_words[w] = self.id_words[x]

    def _merge(self, new: list[str]) -> None:
        pieces = [[w] if w.isalpha() else _PIECE.findall(w) for w in new]
        ids = self.merge("\0".join([p for ps in pieces for p in ps]) + "\0", allowed_special=set())
        piece_end = np.flatnonzero(self.ends[ids]) + 1
        word_end = piece_end[np.cumsum([len(ps) for ps in pieces]) - 1] * 4
        raw, at, known = ids.astype("<u4").tobytes(), 0, self.id_words
        for word, end in zip(new, word_end.tolist(), strict=True):
            known[word] = raw[at:end]
            at = end

    def ids(self, text: str | None) -> bytes:
        """Ids of the whole text as little-endian uint32 bytes; null counts as empty."""
        return next(iter(self.ids_of([text])))

    def ids_of(self, texts: list[str | None]) -> list[bytes]:
        """ids() of each text; words new to the cache are merged together."""
        words = [self.words(t) if t else () for t in texts]
        self.learn(set().union(*words))
        known = self.id_words.__getitem__
        return [b"".join(map(known, ws)) for ws in words]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the library's decode(ids, skip_special_tokens=False): without a decoder, tokens joined by spaces."""
        return b" ".join(map(self.shown.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def word_vocab(path: str) -> WordVocab:
    """One vocabulary per Python worker and file."""
    return WordVocab(path)


def default_path(name: str) -> str:
    """Place of a public vocabulary file on this worker."""
    import public_tokenizers

    return public_tokenizers.path(name)
