"""Spelling variants: words one edit apart, each led to a far more frequent form.

Asymmetric q-chunks.  Of two words one edit apart, the shorter (or either, if they are equally long) contributes two
disjoint chunks, its halves; the other contributes the grams that a chunk can meet, which lie where the chunk
lies or one place on.  One edit leaves one of the halves whole, so that a join of chunks with grams loses no pair.
Where a chunk is shared by more than ``CROWDED`` words of one length, what it leaves open, the part that holds the edit, is
cut into two chunks in turn, on both sides, until few words are left or the open part is a single letter, where all that meet are
real neighbours.  So no key ever yields all pairs of many unlike words.  Every candidate is verified.

Only Spark expressions are used.  Occurrences are counted before anything else is shuffled; words, not texts, are joined.

Null and empty texts have no words; very long texts are taken whole.  Repeated rows count each.  A null doc_id counts as an
empty text in the hash that deletes letters.  Ties of form go to the smaller word in code-point order.  An empty table
gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdlake.llm.common import dealt
from cmdlake.llm.repeats import written

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EVERY, SHORTEST, RAREST, RATIO = 97, 5, 3, 2
#: Words of one length that may share a chunk before it is cut further.
CROWDED = 64


def words(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """Every occurrence's word: the run in lower case, of one in ``every`` (by its hash) without the letter that the hash names."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("d", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """word and n of the words that are long and frequent enough."""
    return words(docs).filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= rarest)


def halves(rows: DataFrame) -> DataFrame:
    """Each row twice: its open part [low, high) without the left half, and without the right half, of the chunk side's open part.

    ``more`` is by how many letters the word is longer than its partners.  The chunk left out goes into the key.
    """
    inner = F.col("high") - F.col("low") - F.col("more")  # letters that the chunk side has open
    left = F.floor(inner / 2).cast("int")
    right = inner - left
    text = lambda at, n: F.substring(F.col("word"), at + 1, n)
    two = F.array(
        F.struct(F.concat("key", F.lit("<"), text(F.col("low"), left)).alias("key"), (F.col("low") + left).alias("low"), F.col("high").alias("high")),
        F.struct(F.concat("key", F.lit(">"), text(F.col("high") - right, right)).alias("key"), F.col("low").alias("low"), (F.col("high") - right).alias("high")),
    )
    return rows.select("word", "n", "more", F.explode(two).alias("x")).select("word", "n", "more", "x.*")


def candidates(vocab: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """a, na, b, nb: pairs of words that share a chunk where one edit could have left it; each pair of near words is among them."""
    size, n_words = F.length("word"), vocab.count()
    start = lambda more: vocab.select("word", "n", F.lit(more).alias("more"), (size - more).cast("string").alias("key"), F.lit(0).alias("low"), size.alias("high"))
    rows, out = halves(start(0).union(start(1))), None
    while True:
        rows = written(dealt(rows, 4 * n_words))
        # a word stands on both sides of its own length; only chunks that a word on the other side meets are of use
        load = rows.groupBy("key").agg(F.sum((F.col("more") == 0).cast("long")).alias("chunks"), F.count("*").alias("all"), F.max(F.col("high") - F.col("low") - F.col("more")).alias("open"))
        load = written(load.filter((F.col("chunks") > 0) & (F.col("all") > 1)).select("key", ((F.col("all") > crowded) & (F.col("open") > 1)).alias("split")))
        named = written(rows.join(load, "key"))
        few = named.filter("not split")
        chunks = few.filter("more = 0").select("key", F.col("word").alias("a"), F.col("n").alias("na"))
        grams = few.select("key", F.col("word").alias("b"), F.col("n").alias("nb"), "more")
        met = chunks.join(grams, "key").filter((F.col("more") == 1) | (F.col("a") < F.col("b"))).filter(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb")
        out = met if out is None else out.union(met)
        crowd = named.filter("split")
        if crowd.isEmpty():
            return out
        rows = halves(crowd.select("word", "n", "more", "key", "low", "high"))


def near_pairs(vocab: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """a, na, b, nb: each pair of words that differ by exactly one inserted, deleted or replaced letter, once."""
    return candidates(vocab, crowded).dropDuplicates(["a", "b"])


def forms(vocab: DataFrame, ratio: int = RATIO, crowded: int = CROWDED) -> DataFrame:
    """word, n, n_near, form and form_n."""
    pairs = near_pairs(vocab, crowded)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m")))).alias("x")).select("x.*")
    most = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("most"))
    leads = -F.col("most.less") >= ratio * F.col("n")
    return vocab.join(most, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(leads, F.col("most.near")).alias("form"), F.when(leads, -F.col("most.less")).alias("form_n")
    )


def roots(found: DataFrame) -> DataFrame:
    """word and root of the words with a form: pointers double until all have arrived; counts at least double along a chain, so rounds are few."""
    at = written(found.filter("form is not null").select("word", F.col("form").alias("root")))
    rows = at.count()
    while True:
        hop = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(dealt(at.join(hop, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), rows))
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """word, n, n_near, form, form_n and root, a row for each word of the vocabulary."""
    found = written(forms(written(vocabulary(docs)), crowded=crowded))
    return found.join(roots(found), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
