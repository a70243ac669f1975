"""Language identification by sparse multinomial logistic regression.

Hashed character 1- to 3-gram TF-IDF features (term frequency relative to the text's n-grams),
fitted by follow-the-regularised-leader with elastic-net penalties on a bounded sample of
labelled rows (``SAMPLE_ROWS`` expected over all languages, drawn by a hash of the text among texts
of up to ``SAMPLE_CHARS`` characters, so that what reaches the driver is bounded), then
a temperature fitted on a fifth of the sample that the weights never saw.  The table of
weights has a fixed size; every text is scored whole.

Null texts, and texts without a letter, are ``und`` with score 0.  With no labelled row every
text is ``und``.  Of languages with equal scores the first by name is given.  Repeated rows are
judged alike, and count once when the model is fitted.  Very long texts are scored whole.  Other
columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdlake.llm.common import chunks

SAMPLE_ROWS, SAMPLE_CHARS = 4000, 20_000
BUCKETS, ORDERS, SCALE = 1 << 17, 3, 40.0


def has_letter(text: str) -> bool:
    """Whether any character is a letter; numbers such as ½, ² or Ⅷ are none."""
    return any(map(str.isalpha, text))


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Per order, feature of each position of the joined texts; and where each text starts."""
    low = ["\n" + t.lower() + "\n\n" for t in texts]  # ends keep n-grams of two texts apart
    code = np.frombuffer("".join(low).encode("utf-32-le"), "<u4").astype("u4")
    starts = np.concatenate(([0], np.cumsum([len(t) for t in low])))
    out, mixed = [], np.zeros(len(code), "u4")
    for n in range(ORDERS):
        mixed = mixed * np.uint32(0x01000193)
        mixed[: len(code) - n] += code[n:]
        spread = (mixed + np.uint32(n + 1)) * np.uint32(0x9E3779B1)
        out.append((spread >> np.uint32(32 - 17)).astype("i4"))
    return out, starts


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their share of its n-grams."""
    found, n = np.unique(np.concatenate(grams([text])[0]), return_counts=True)
    return found, n / n.sum()


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[tuple[np.ndarray, np.ndarray], str]], alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3) -> dict:
    """Languages, feature weights (IDF folded in), bias and temperature, from rows of counts() and language."""
    langs = sorted({lang for _, lang in rows})
    xs, ys = [x for x, _ in rows], np.array([langs.index(lang) for _, lang in rows])
    df = np.zeros(BUCKETS)
    for f, _ in xs:
        df[f] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    z, n, bias = np.zeros((BUCKETS, len(langs))), np.zeros((BUCKETS, len(langs))), np.zeros(len(langs))
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(np.flatnonzero(~held)):
            f, tf = xs[i]
            x = tf * idf[f] * SCALE
            w = weights(z[f], n[f])
            p = softmax(x @ w + bias)
            p[ys[i]] -= 1
            g = x[:, None] * p[None]
            z[f] += g - (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha * w
            n[f] += g * g
            bias -= 0.02 * p
    w = weights(z, n) * idf[:, None] * SCALE
    temperature = 1.0
    if held.any():
        logits = np.array([xs[i][1] @ w[xs[i][0]] + bias for i in np.flatnonzero(held)])
        grid = np.geomspace(0.1, 10, 81)
        loss = [-np.log(softmax(logits / t)[np.arange(len(logits)), ys[held]] + 1e-12).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return {"langs": langs, "w": w.astype("f4"), "bias": bias, "t": temperature}


def predict(texts: list[str], model: dict) -> np.ndarray:
    """Calibrated probabilities of whole texts, a row each."""
    features, starts = grams(texts)
    total = np.zeros((len(texts), len(model["langs"])))
    for k in range(total.shape[1]):
        column = np.ascontiguousarray(model["w"][:, k])
        for f in features:
            total[:, k] += np.add.reduceat(column[f], starts[:-1], dtype="f8")
    return softmax((total / (ORDERS * np.diff(starts))[:, None] + model["bias"]) / model["t"])


def train(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> dict | None:
    """Fit on an expected ``rows`` of (text, lang) at most; the draw depends on each text alone and is even over languages.

    Copies of a text count once, so that however often a drawn text repeats, the driver gets it once.
    """
    labelled = labelled.filter(F.length("text") <= SAMPLE_CHARS)
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    each = rows / len(sizes)
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, each / n))]), F.col("lang"))
    drawn = labelled.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * float(1 << 30))
    sample = sorted((r["text"], r["lang"]) for r in drawn.select("text", "lang").distinct().collect() if has_letter(r["text"]))
    return fit([(counts(t), lang) for t, lang in sample]) if sample else None


def verdicts(texts: list[str | None], model: dict | None) -> tuple[list[str], np.ndarray]:
    """Language and calibrated probability of each text."""
    lang, score = ["und"] * len(texts), np.zeros(len(texts))
    for a, b in chunks(texts):
        known = [i for i in range(a, b) if model and texts[i] and has_letter(texts[i])]
        if known:
            p = predict([texts[i] for i in known], model)
            for i, k, s in zip(known, p.argmax(axis=1), p.max(axis=1), strict=True):
                lang[i], score[i] = model["langs"][k], s
    return lang, score


def language_of(text: Column, model: dict | None) -> Column:
    """struct(lang_pred, score) of a text column."""
    shared = SparkContext.getOrCreate().broadcast(model)  # BUCKETS x languages, fixed

    def run(texts: pd.Series) -> pd.DataFrame:
        lang, score = verdicts(texts.tolist(), shared.value)
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return F.pandas_udf(run, "lang_pred string, score double")(text)


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score of every text."""
    return docs.select("doc_id", language_of(F.col("text"), model).alias("x")).select("doc_id", "x.*")
