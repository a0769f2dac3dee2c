"""Benchmark decontamination by spaced seeds, in built-in functions only.

A seed is a fixed mask over consecutive words: the hash takes the words where the mask has 1 and ignores the others. Seeds of all benchmark
items are joined with the seeds of all documents; each hit names a document, an item and how far one is shifted against the other. Around
a hit the words of both are then held against each other at that shift, so substituted words are tolerated. A document is contaminated if
in some WINDOW consecutive words of an item at least PERCENT of 100 are equal; an item with fewer words must occur whole. The two masks
between them hit every window with as many substitutions as that allows (a test goes through all of them), so no overlap is missed. Items
shorter than the masks have a mask of their own length, which documents use only if there is such an item.

Defined results: null texts have no words, and an item without words matches nothing; words are compared with A-Z in lower
case. An item or document that is repeated counts once for each id. Null ids match like others and are kept apart by their texts. The seeds
of the benchmark are broadcast up to a counted size and joined by a shuffle beyond it. Columns of any other names are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import fitting, own, unused, words
from stratalens.staging import stage

#: Words of a window, the share of them that must be equal, and the masks.
WINDOW, PERCENT = 13, 80
MASKS = ("11111", "111101")


def key() -> Column:
    """Tells rows of equal or null ids apart."""
    return F.xxhash64("doc_id", "text").alias("_key")


def seeds(hashes: Column, masks: tuple[str, ...]) -> Column:
    """The seed of each mask at each place, mask after mask; hashes are those of the words."""
    found = []
    for mask in masks:
        places = F.sequence(F.lit(0), F.size(hashes) - len(mask))
        found.append(F.when(F.size(hashes) >= len(mask), F.transform(places, masked(hashes, mask))).otherwise(F.array().cast("array<bigint>")))
    return F.concat(*found)


def masked(hashes: Column, mask: str) -> Callable[[Column], Column]:
    taken = [i for i, x in enumerate(mask) if x == "1"]
    return lambda at: F.xxhash64(F.lit(int(mask, 2)), *[hashes[at + i] for i in taken])


def place(number: Column, n: Column, masks: tuple[str, ...]) -> Column:
    """The word at which the seed of that number starts, in a text of n words."""
    before, at = F.lit(0), None
    for mask in masks:
        own = F.when((number >= before), number - before)
        at = own if at is None else F.coalesce(own, at)
        before = before + F.greatest(n - (len(mask) - 1), F.lit(0))
    return at


def seeded(rows: DataFrame, masks: tuple[str, ...], *columns: str) -> DataFrame:
    """A row for each seed of rows with an array of words: the columns, the seed and its place."""
    hashed = rows.select(*columns, F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    each = hashed.select(*columns, F.size("hashes").alias("n"), F.posexplode(seeds(F.col("hashes"), masks)).alias("number", "seed"))
    return each.select(*columns, "seed", place(F.col("number"), F.col("n"), masks).alias("at"))


def overlap(doc: Column, item: Column, shift: Column) -> Column:
    """The most equal words in a window of the item at this shift, with the place in the document; null if there are too few."""
    first, last = F.greatest(F.lit(0), -shift), F.least(F.size(item), F.size(doc) - shift) - 1
    equal = F.transform(F.sequence(first, last), lambda i: F.when(item[i] == doc[i + shift], 1).otherwise(0))
    width = F.least(F.size(item), F.lit(WINDOW))
    need = F.when(F.size(item) < WINDOW, F.size(item)).otherwise(-(-WINDOW * PERCENT // 100))
    windows = F.transform(F.sequence(F.lit(0), F.size(equal) - width), lambda i: F.struct(
        F.aggregate(F.slice(equal, i + 1, width), F.lit(0), lambda a, x: a + x).alias("equal"), (-(first + shift + i)).alias("back")))
    best = F.array_max(windows)
    return F.when((last - first + 1 >= width) & (best["equal"] >= need),
                  F.struct(best["equal"].alias("n_equal"), width.alias("n_words"), (-best["back"]).alias("start")))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, _key, item_id, n_equal, n_words and start (word in the document) of the best window of each item that a document holds."""
    items = stage(benchmark.select("item_id", words(F.col("text")).alias("words")).distinct(), "items")
    size, least = F.size("words"), min(map(len, MASKS))
    short = sorted(r["n"] for r in items.filter((size > 0) & (size < least)).select(size.alias("n")).distinct().collect())
    known = seeded(items.filter(size >= least), MASKS, "item_id")
    for n in short:
        known = known.unionByName(seeded(items.filter(size == n), ("1" * n,), "item_id"))
    known = stage(known.select("seed", "item_id", F.col("at").alias("item_at")), "seeds")
    texts = docs.select("doc_id", key(), words(F.col("text")).alias("words"))
    found = seeded(texts, (*MASKS, *["1" * n for n in short]), "doc_id", "_key").join(fitting(known), "seed")
    found = stage(found.select("doc_id", "_key", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "hits")
    # only documents with a hit are read again
    near = docs.select("doc_id", "text", key()).join(fitting(found.select("_key").distinct()), "_key", "left_semi")
    near = near.select(F.col("doc_id").alias("_doc"), F.col("_key").alias("_text"), words(F.col("text")).alias("doc")).distinct()
    both = found.join(near, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_text")))
    both = both.join(items.select(F.col("item_id").alias("_item"), F.col("words").alias("item")), F.col("item_id").eqNullSafe(F.col("_item")))
    seen = both.select("doc_id", "_key", "item_id", overlap(F.col("doc"), F.col("item"), F.col("shift")).alias("o")).filter("o IS NOT NULL")
    return seen.groupBy("doc_id", "_key", "item_id").agg(F.max("o").alias("o")).select("doc_id", "_key", "item_id", "o.n_equal", "o.n_words", "o.start")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    return hits(docs, benchmark).drop("_key")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item."""
    bad = fitting(stage(hits(docs, benchmark).select("doc_id", "_key").distinct(), "leaks"))
    at, doc, text = (unused(docs, name) for name in ("_at", "_doc", "_bad"))
    bad = bad.select(F.col("doc_id").alias(doc), F.col("_key").alias(text))
    return docs.withColumn(at, key()).join(bad, (F.col(at) == F.col(text)) & F.col("doc_id").eqNullSafe(F.col(doc)), "left_anti").select(own(docs))
