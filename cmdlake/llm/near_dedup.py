"""MinHash near-duplicates from bottom-k sketches of one hash function.

A document's set of word shingles is hashed once; its ``k`` smallest values are its sketch.
Documents of equal sets form a class.  Each class enters the inverted lists of its rarest
sketch values: any class as similar as the threshold shares at least ``least_shared`` of
them, so the k - least_shared + 1 rarest hold a common one (for sets no larger than k the
bound is exact; beyond, it fails with a probability under 1e-9 a pair).  Pairs met in a list
are filtered by size and by the union sketch's estimate and verified on the full sets.

A list of more than ``SHORT_LIST`` classes is never expanded into its pairs.  The classes of
such lists enter lists by their full sets instead, which needs no estimate: rarest values
first, of two sets as similar as the threshold the larger has a value of the smaller's
shortest useful prefix at a place that leaves room for the overlap asked for (``Reach``).
There each list first meets one member, the one with the fewest rarer values; links found
name components, and only pairs of different components are looked for, by list and size.

Null, empty and blank texts have no shingles, link with nothing and are kept.  Very long texts
are one row each, and only sketches and shingle hashes of them move.  Rows equal in doc_id and
text are judged alike; rows that repeat a doc_id with other texts are judged each by its text.
A null doc_id never names a component others are in.  Of a group's equal smallest ids all rows
are kept.  Columns other than doc_id and text are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cmdlake.llm import repeats
from cmdlake.llm.common import cut, dealt, fresh
from cmdlake.llm.components import components

SHINGLE, SKETCH, LEAST_SHARED = 5, 32, 12
SHORT_LIST = 24
#: Pairs whose full sets one task compares.
TASK_PAIRS = 2_000
#: Hops over links that name a component while pairs are looked for; more would only skip more pairs.
HOPS = 2
#: Stands for a null doc_id: larger than any other.
LAST = 2**63 - 1


def shingle_sets(raw: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each lower-cased text; short texts have their whole sequence as one."""
    words, starts = repeats.word_symbols([x.lower() for x in raw])
    at = np.arange(len(words))
    ends = np.minimum(at + width, np.repeat(starts[1:], np.diff(starts)))
    hashes = (repeats.substring_hashes(words, at, ends) >> np.uint64(1)).view("i8")
    out = []
    for a, e in zip(starts[:-1], starts[1:], strict=True):
        out.append(np.unique(hashes[a : max(a + 1, e - width + 1)]) if e > a else np.zeros(0, "i8"))
    return out


def describe(docs: DataFrame, width: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """d, k, n (set size), c (hash of the set; 0 for none), sketch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part in repeats.batches(pdf):
                sets = shingle_sets([t.encode() for t in part["text"]], width)
                joined = np.concatenate([*sets, np.zeros(1, "i8")]).view("u8")
                ends = np.cumsum([len(s) for s in sets])
                names = repeats.substring_hashes(joined, ends - [len(s) for s in sets], ends).view("i8")
                sizes = np.diff(np.concatenate(([0], ends)))
                yield pd.DataFrame({"d": part["d"].to_numpy(), "k": part["k"].to_numpy(), "n": sizes, "c": np.where(sizes > 0, names, 0), "sketch": [s[:k] for s in sets]})

    return repeats.keyed(docs).mapInPandas(run, "d long, k long, n long, c long, sketch array<long>")


def least_shared(n: Column, share: int, k: int) -> Column:
    """Sketch values that a set of n shares with any set similar enough (see the module's text)."""
    exact = F.ceil(n * share / 100) - F.greatest(F.lit(0), F.floor(n * 100 / share) - k)
    return F.when(n >= k, F.lit(LEAST_SHARED if share >= 85 else LEAST_SHARED - 2)).otherwise(F.greatest(F.lit(1), exact)).cast("int")


def least_overlap(one: Column, two: Column, share: int) -> Column:
    """Common values that two sets of these sizes have at least if they are similar enough."""
    return F.ceil((one + two) * share / (100 + share))


def size_bucket(n: Column, share: int) -> Column:
    """Eight buckets of sizes between a size and the smallest one it may be linked to."""
    return F.floor(F.log(n.cast("double")) / (-np.log(share / 100) / 8)).cast("int")


def full_lists(full: DataFrame, share: int) -> DataFrame:
    """v, c, n, i: the values by which a set can meet another, each with the number of its rarer ones."""
    values = full.select("c", "n", F.explode("body").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    by = F.array_sort(F.collect_list(F.struct("df", "v")))
    reach = F.col("n") - F.ceil(F.col("n") * share / 100) + 1
    rare = F.col("n") - F.size("by")  # values of no other set
    return (
        values.join(often.hint("merge"), "v").groupBy("c", "n").agg(by.alias("by"))
        .select("c", "n", rare.alias("rare"), F.posexplode(F.slice("by", F.lit(1), F.greatest(F.lit(0), reach - rare).cast("int"))).alias("at", "x"))
        .select("x.v", "c", "n", (F.col("rare") + F.col("at")).alias("i"))
    )


def verified(pairs: DataFrame, full: DataFrame, share: int) -> DataFrame:
    """Of pairs (a, b) of classes, those whose full sets are similar enough."""
    pairs = repeats.written(pairs)
    rows = pairs.count()
    one, two = (full.select(F.col("c").alias(x), F.col("body").alias(f"body_{x}")).hint("merge") for x in "ab")
    both = F.size(F.array_intersect("body_a", "body_b")).cast("long")
    met = dealt(dealt(pairs.join(one, "a"), rows, TASK_PAIRS).join(two, "b"), rows, TASK_PAIRS)
    links = cut(met.filter(both * 100 >= (F.size("body_a") + F.size("body_b") - both) * share).select("a", "b"))
    repeats.discard(pairs)
    return links


def near_labels(links: DataFrame) -> DataFrame:
    """c, comp: equal only for classes that links connect; a class without links has no row."""
    rows = links.count()
    both = links.union(links.select("b", "a")).toDF("x", "y")
    label = dealt(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("comp")), rows)
    for _ in range(HOPS - 1):
        hop = dealt(both.join(label.withColumnRenamed("x", "y").hint("merge"), "y"), rows).select("x", "comp").union(label)
        label = dealt(hop.groupBy("x").agg(F.min("comp").alias("comp")), rows)
    return label.withColumnRenamed("x", "c")


def near_components(docs: DataFrame, share: int = 85, width: int = SHINGLE, k: int = SKETCH, short_list: int = SHORT_LIST) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row per document; row_hash tells rows of one doc_id apart."""
    rows = repeats.written(describe(docs, width, k))
    ids = rows.select(F.when(F.col("d") == repeats.NONE, F.lit(LAST)).otherwise(F.col("d")).alias("d"), "k", "n", "c")
    classes = repeats.written(
        rows.filter("n > 0").groupBy("c").agg(F.min(F.struct("d", "k")).alias("one"), F.min(F.when(F.col("d") != repeats.NONE, F.col("d"))).alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        .select("c", "one.*", F.coalesce("least", F.lit(LAST)).alias("least"), "n", "sketch")
    )

    # rarest values first; values of one class only take places but open no list
    values = classes.select("c", "n", F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    places = F.least(F.col("n"), F.lit(k)) - least_shared(F.col("n"), share, k) + 1
    own = F.least(F.col("n"), F.lit(k)) - F.size("by")
    lists = repeats.written(
        values.join(often.hint("merge"), "v").groupBy("c", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("by"))
        .select("c", "n", F.explode(F.slice("by", F.lit(1), F.greatest(F.lit(0), places - own).cast("int"))).alias("x"))
        .select("c", "n", "x.*")
    )

    n_lists = lists.count()

    # short lists: their pairs, filtered by size and union sketch
    short = lists.filter(F.col("df") <= short_list)
    x, y = (short.select("v", F.col("c").alias(c), F.col("n").alias(f"n{c}")) for c in "ab")
    met = x.join(y, "v").filter("a < b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * share).select("a", "b").distinct()
    sa, sb = (classes.select(F.col("c").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")).hint("merge") for c in "ab")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    pairs = repeats.written(
        dealt(dealt(met, n_lists).join(sa, "a"), n_lists).join(sb, "b")
        .filter(shared >= F.least(least_shared(F.col("na"), share, k), least_shared(F.col("nb"), share, k)))
        .select("a", "b")
    )

    # full sets of the classes still in question
    hot = lists.filter(F.col("df") > short_list).select("c").distinct().withColumn("hot", F.lit(1))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("c")).withColumn("hot", F.lit(0)).union(hot).groupBy("c").agg(F.max("hot").alias("hot"))

    def pull(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part in repeats.batches(pdf):
                sets = shingle_sets([t.encode() for t in part["text"]], width)
                yield pd.DataFrame({"c": part["c"].to_numpy(), "n": [len(s) for s in sets], "hot": part["hot"].to_numpy(), "body": sets})

    once = repeats.keyed(docs).dropDuplicates(["d", "k"])  # equal rows are one row here, so each class has one set
    full = repeats.written(
        once.join(classes.join(wanted.hint("merge"), "c").select("d", "k", "c", "hot"), ["d", "k"])
        .select("text", "c", "hot").mapInPandas(pull, "c long, n long, hot int, body array<long>")
    )
    links = verified(pairs, full, share)

    # long lists: one member of each list first, then members of other components
    entries = repeats.written(full_lists(full.filter("hot = 1"), share))
    n_entries = entries.count()
    center = entries.groupBy("v").agg(F.min_by(F.struct("c", "n", "i"), F.struct("i", "c")).alias("p"))
    fits = lambda n, i, m, j: (F.least(n, m) * 100 >= F.greatest(n, m) * share) & (F.least(n - i, m - j) >= least_overlap(n, m, share))
    first = (
        dealt(entries.join(dealt(center, n_entries).hint("merge"), "v"), n_entries)
        .filter((F.col("c") != F.col("p.c")) & fits(F.col("n"), F.col("i"), F.col("p.n"), F.col("p.i")))
        .select(F.least("c", "p.c").alias("a"), F.greatest("c", "p.c").alias("b")).distinct()
    )
    links = links.union(verified(dealt(first, n_entries), full, share))
    named = repeats.written(dealt(entries.join(near_labels(links).hint("merge"), "c", "left").withColumn("comp", F.coalesce("comp", "c")), n_entries))
    # the larger set looks for smaller ones in every bucket of sizes that its place in the list allows
    most = F.least(F.col("n"), F.floor((F.col("n") - F.col("i")) * (100 + share) / share) - F.col("n"))
    asking = named.withColumn("low", F.ceil(F.col("n") * share / 100)).withColumn("most", most).filter("most >= low").select("v", F.col("c").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("comp").alias("compa"), F.explode(F.sequence(size_bucket(F.col("low"), share), size_bucket(F.col("most"), share))).alias("bucket"))
    asked = named.filter(F.col("n") - F.col("i") >= least_overlap(F.col("n"), F.col("n"), share)).select("v", F.col("c").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("comp").alias("compb"), size_bucket(F.col("n"), share).alias("bucket"))
    rest = (
        dealt(asking.join(asked.hint("merge"), ["v", "bucket"]), n_entries)
        .filter((F.col("nb") < F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("a") < F.col("b"))))
        .filter((F.col("compa") != F.col("compb")) & fits(F.col("na"), F.col("ia"), F.col("nb"), F.col("ib")))
        .select("a", "b").distinct()
    )
    links = links.union(verified(dealt(rest, n_entries), full, share))
    joined = components(links).withColumnRenamed("node", "c")
    repeats.discard(lists, pairs, full, entries, named)
    least = joined.join(classes.select("c", "least"), "c").groupBy("component").agg(F.min("least").alias("component_id"))
    linked = joined.join(least, "component").select("c", "component_id")
    ids_of = classes.select("c", "least").join(linked, "c", "left").select("c", F.coalesce("component_id", "least").alias("component_id"))
    real = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return (
        ids.join(ids_of, "c", "left").withColumn("component_id", F.coalesce("component_id", "d"))
        .select(real("d").alias("doc_id"), F.col("n").alias("n_shingles"), real("component_id").alias("component_id"), (F.col("d") == F.col("component_id")).alias("kept"), F.col("k").alias("row_hash"))
    )


def one_of_each(docs: DataFrame, share: int = 80) -> DataFrame:
    """The documents that near_components keeps, all columns; of fully repeated rows one stays."""
    kept = near_components(docs, share).filter("kept").select(F.coalesce("doc_id", F.lit(repeats.NONE)).alias("d"), "row_hash").distinct()
    d, k, n = fresh(docs, "d", "k", "n")
    named = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(repeats.NONE)), k: F.xxhash64("doc_id", "text")})
    nth = F.row_number().over(Window.partitionBy(d, k).orderBy(F.lit(0)))
    return named.join(kept.toDF(d, k), [d, k], "left_semi").withColumn(n, nth).filter(F.col(n) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
