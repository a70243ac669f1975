"""Quality rules: repetition, and tokeniser fertility with bands by script.

A public byte-level vocabulary measures characters per token, the share of tokens that are
not whole characters (byte fallback) and the entropy of the token distribution of each whole
text.  A text of any length is rejected if a figure lies outside its script's band; what
entropy is asked for grows with the number of tokens.  Null and empty texts have no words and
fail the base rule.  Repeated rows are judged alike.  Very long texts are judged whole.  A figure
on a bound lies inside the band; of scripts with as many letters the first of BANDS is taken.
Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdlake.llm.vocab import default_path

#: By script: least and most characters a token, largest byte-fallback share, share of LEAST_BITS asked for.
#: The least figure lies between running text and random letters or symbol noise of the script (README).
BANDS = {
    "latin": (2.0, 7.0, 0.1, 1.0), "cyrillic": (1.7, 7.0, 0.1, 1.0), "greek": (1.5, 7.0, 0.12, 1.0), "arabic": (1.4, 7.0, 0.2, 1.0), "hebrew": (1.5, 7.0, 0.3, 1.0),
    "devanagari": (0.8, 5.0, 0.7, 0.75), "indic": (0.45, 5.0, 0.95, 0.6), "thai": (0.8, 5.0, 0.4, 0.75), "kana": (0.8, 5.0, 0.4, 1.0), "hangul": (1.1, 5.0, 0.6, 1.0), "han": (0.6, 4.0, 0.55, 1.0),
    "other": (0.36, 7.0, 1.0, 0.5),
}
#: Least entropy in bits by the binary logarithm of the number of tokens, straight in between.
LEAST_BITS = ((0, 3, 4.5, 5, 6, 7, 8, 9, 10, 11, 13), (0, 2.3, 3.7, 4.0, 4.6, 5.35, 5.85, 6.1, 6.25, 6.35, 6.5))
_BLOCKS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("arabic", 0xFB50, 0xFEFC),
    ("devanagari", 0x900, 0x97F), ("indic", 0x980, 0xDFF), ("thai", 0xE00, 0xE7F), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7A3), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("han", 0xF900, 0xFAFF),
)
_SCRIPTS = list(BANDS)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The script of each letter of the basic plane, by position in BANDS; the last number stands for what is no letter."""
    found = np.fromiter((len(_SCRIPTS) - 1 if chr(i).isalpha() else len(_SCRIPTS) for i in range(1 << 16)), "u1", 1 << 16)
    for name, first, last in _BLOCKS:
        part = found[first : last + 1]
        part[part < len(_SCRIPTS)] = _SCRIPTS.index(name)
    return found


def script_of(text: str) -> str:
    """The script of most letters; texts without letters are held to the Latin band."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = np.bincount(_letters()[points[points < 1 << 16]], minlength=len(_SCRIPTS) + 1)[:-1]
    n[_SCRIPTS.index("han")] += int(((points >= 0x20000) & (points < 0x40000)).sum())
    return _SCRIPTS[int(n.argmax())]


@lru_cache(maxsize=2)
def _vocab(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding, and which ids are not whole UTF-8 characters."""
    import public_tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    part = np.zeros(max(ranks.values()) + 1, bool)
    for raw, i in ranks.items():
        try:
            raw.decode()
        except UnicodeDecodeError:
            part[i] = True
    return tiktoken.Encoding("fertility", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), part


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    n = len(words)
    if n <= width:
        return 0
    code = np.fromiter(map(hash, words), "i8", n).astype("u8")
    rolled = np.zeros(n - width + 1, "u8")
    for k in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + (code[k : n - width + 1 + k] ^ code[k : n - width + 1 + k] >> np.uint64(29))
    order = np.argsort(rolled)
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n - width + 1, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    edge = np.zeros(n + 1, "i4")
    np.add.at(edge, np.flatnonzero(hit), 1)
    np.add.at(edge, np.flatnonzero(hit) + width, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def fertility(text: str, vocab: tuple[tiktoken.Encoding, np.ndarray]) -> tuple[int, float, float, float]:
    """Tokens, characters a token, byte-fallback share and entropy in bits."""
    ids = vocab[0].encode_to_numpy(text, disallowed_special=())
    if not len(ids):
        return 0, 0.0, 0.0, 0.0
    counts = np.unique(ids, return_counts=True)[1] / len(ids)
    return len(ids), len(text) / len(ids), float(vocab[1][ids].mean()), float(-(counts * np.log2(counts)).sum())


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, n_tokens long, chars_per_token double, byte_share double, entropy double"


def judge(text: str | None, vocab: tuple[tiktoken.Encoding, np.ndarray], bands: dict) -> tuple:
    """The fields of SCHEMA for one text."""
    text = text or ""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.encode().split()]
    n, repeat = len(words), repeated_words(words)
    failed = n < 10 or 100 * repeat > 20 * n
    tokens, per, share, bits = fertility(text, vocab)
    script = script_of(text)
    low, high, most, least = bands[script]
    out = tokens > 0 and not (low <= per <= high and share <= most and bits >= least * np.interp(np.log2(tokens), *LEAST_BITS))
    blank = sum(map(text.count, " \t\n\v\f\r"))
    return n, len(text) - blank, sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), repeat, failed, not (failed or bool(out)), script, tokens, per, share, bits


def quality_of(text: Column, bands: dict = BANDS, vocab_path: str | None = None) -> Column:
    """struct of SCHEMA for a text column."""

    def run(texts: pd.Series) -> pd.DataFrame:
        vocab = _vocab(vocab_path or default_path("byte_bpe_multi_50k.tiktoken"))
        return pd.DataFrame([judge(t, vocab, bands) for t in texts.tolist()], columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    return F.pandas_udf(run, SCHEMA)(text)


def quality(docs: DataFrame, bands: dict = BANDS, vocab_path: str | None = None) -> DataFrame:
    """doc_id, counts, fertility figures and verdict of every text."""
    return docs.select("doc_id", quality_of(F.col("text"), bands, vocab_path).alias("x")).select("doc_id", "x.*")
