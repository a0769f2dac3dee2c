"""N-gram Jaccard self-join of documents by grouped prefixes, and its connected components.

A document's set is that of its distinct word shingles, as 64-bit hashes. Two documents link when 100 * intersection >= 80 * union. The
elements have one global order, roughly rare ones first. Linked sets of n and m elements then share an element among their first
n - ceil(0.8 n) + 1 and m - ceil(0.8 m) + 1, their prefixes; and where the first shared element stands bounds how many they can share.

1. Sketch: how often each of a fixed number of hash cells occurs, over all documents. Only the order rests on it: passages shared by many
   documents go last and rarely stand in a prefix. Any order gives the same links.
2. Signatures: each document's prefix. Documents with equal sets become one node, nodes with equal prefixes and sizes one group.
3. Group pairs: in each element's bucket the group where the element stands first is compared with all others by size and position, so a
   bucket of many copies gives as many pairs as it has groups, not their square.
4. Members: pairs of groups are expanded to their nodes, and the nodes of a group are held against its first; the sets of these pairs are
   compared exactly.
5. Rest: where, beside its first, a bucket still holds several components, all pairs across components that pass the same filters are
   compared as well, in salted blocks. A pair left out is thus already joined by verified links, so no link between components is lost.

Defined results: a document without words, or with a null text, has an empty set and links with nothing. Rows of equal ids are one document
of several texts. A row with a null id links with nothing and has a null component. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalens.llm.common import fitting, pieces, tidied
from stratalens.operators.graph import connected_components
from stratalens.staging import stage

#: Words in a shingle; the least similarity in percent.
WORDS, PERCENT = 5, 80
#: Cells of the sketch, as a power of two, and cells in one row of its sums.
SKETCH_BITS, SKETCH_ROW = 24, 1 << 14
#: Sets a task counts before it sends its cells on.
SKETCH_SETS = 60_000
#: Bytes of text handled at once, and rows of a bucket that meet in one block of the last step.
CHUNK, BLOCK = 1_000_000, 500

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 32
#: A random value for each byte, equal for A-Z and a-z.
_BYTE = mixed((_LOWER.astype(np.uint64) + np.uint64(1)) * _STEP)
_BASE = np.uint64(0x5851F42D4C957F2D)


def powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), base, np.uint64))])[:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a text of bytes, and the place of its first byte."""
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    # a polynomial of the bytes after the word's start, by Horner's rule along the longest word
    lengths, value = ends - starts, np.zeros(len(starts), np.uint64)
    order = np.argsort(-lengths, kind="stable")
    live, at, ordered = len(order), starts[order], lengths[order]
    value = np.zeros(len(order), np.uint64)
    for k in range(int(ordered[0])):
        live = int(np.searchsorted(-ordered[:live], -k, side="left")) if k else live
        value[:live] = value[:live] * _BASE + _BYTE[data[at[:live] + k]]
    out = np.empty(len(order), np.uint64)
    out[order] = value
    return mixed(out + lengths.astype(np.uint64) * _STEP), starts


def shingles(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    hashes, starts = word_hashes(np.frombuffer(b"\n".join([*texts, b""]), np.uint8))
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    whole = hashes[:max(len(hashes) - words + 1, 0)].copy()
    for k in range(1, words):
        whole = mixed(whole + _STEP) + hashes[k:k + len(whole)]
    whole = mixed(whole)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            sets.append(np.unique(whole[a:b - words + 1]))
        elif b > a:
            # fewer words: one element, which also depends on their number
            value = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    value = mixed(value + _STEP) + h
            sets.append(mixed(np.array([value], np.uint64) * _STEP))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def in_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    for batch in batches:
        texts = batch["text"].tolist()
        for part in pieces([len(x) for x in texts], CHUNK):
            yield batch.iloc[part], shingles(texts[part])


def raw_text() -> Column:
    return F.coalesce("text", F.lit("")).cast("binary").alias("text")


def cell(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def sketch(docs: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """For each cell a level: how many times, as a power of two, it holds more than the mean cell. Its size is fixed by bits."""

    @tidied
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, elements = np.zeros(1 << bits, np.uint16), 0

        def sent() -> Iterator[pd.DataFrame]:
            for at in range(0, len(total), SKETCH_ROW):
                part = total[at:at + SKETCH_ROW]
                if part.any():
                    # a byte is enough for most parts
                    small = part.astype(np.uint8) if part.max() < 256 else part
                    yield pd.DataFrame({"at": [at], "cells": [zlib.compress(small.tobytes(), 1)]})
            total[:] = 0

        for _, sets in in_chunks(batches):
            # a set counts once for an element, so cells can't overflow before so many sets; cells that several elements share are few
            if elements + len(sets) > SKETCH_SETS:
                yield from sent()
                elements = 0
            cells, n = np.unique(cell(np.concatenate(sets), bits), return_counts=True)
            total[cells] = np.minimum(total[cells].astype(np.int64) + n, 65_535)
            elements += len(sets)
        yield from sent()

    def unpacked(cells: bytes) -> np.ndarray:
        data = zlib.decompress(cells)
        return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(data) // SKETCH_ROW]).astype(np.uint64)

    def summed(key: tuple[int], rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(unpacked(x) for x in rows["cells"])
        small = total.astype(np.uint32) if total.max() < 1 << 32 else total
        return pd.DataFrame({"at": [key[0]], "sum": [int(total.sum())], "cells": [zlib.compress(small.tobytes(), 1)]})

    rows = docs.select(raw_text()).mapInPandas(counted, "at long, cells binary").groupBy("at").applyInPandas(summed, "at long, sum long, cells binary").collect()
    mean = max(sum(r["sum"] for r in rows) / (1 << bits), 1)
    levels = np.zeros(1 << bits, np.uint8)
    for r in rows:
        levels[r["at"]:r["at"] + SKETCH_ROW] = np.log2(1 + unpacked(r["cells"]) / mean)
    return levels


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


SIGNATURE = "doc_id long, n int, set_id binary, group_id binary, prefix array<long>"


def signatures(docs: DataFrame, levels: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """The size, identity, group and prefix of each document's set."""
    bits = int(len(levels)).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    @tidied
    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, sets in in_chunks(batches):
            out = []
            for doc_id, s in zip(rows["doc_id"], sets, strict=True):
                prefix = np.zeros(0, np.uint64)
                if len(s):
                    p = prefix_size(len(s), percent)
                    level = shared.value[cell(s, bits)]
                    prefix = s[np.lexsort((s, level))[:p]]
                out.append((doc_id, len(s), set_id(s), hashlib.blake2b(len(s).to_bytes(8, "big") + prefix.tobytes(), digest_size=16).digest(), prefix.view(np.int64)))
            yield pd.DataFrame(out, columns=["doc_id", "n", "set_id", "group_id", "prefix"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", raw_text()).mapInPandas(signed, SIGNATURE)


def set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def may_link(n: Column, at: Column, m: Column, other: Column, percent: int = PERCENT) -> Column:
    """Whether sets of n and m elements whose first shared element stands at `at` and `other` can be similar enough."""
    size = (100 * F.least(n, m) >= percent * F.greatest(n, m))
    # intersection i of similar sets: 100 i >= percent (n + m - i)
    return size & ((1 + F.least(n - at, m - other) - 1) * (100 + percent) >= percent * (n + m))


def first_pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different groups, the first of a bucket with each other one that it may link with."""
    found = buckets.filter((F.col("head") != F.col("first.head")) & may_link(F.col("n"), F.col("at"), F.col("first.n"), F.col("first.at"), percent))
    return found.select(F.col("first.head").alias("a"), F.col("head").alias("b")).distinct()


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its set as bytes, for nodes (node, set_id); computed again from the text."""

    @tidied
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, sets in in_chunks(batches):
            yield pd.DataFrame({"node": rows["doc_id"].to_numpy(), "set_id": [set_id(s) for s in sets], "elements": [s.tobytes() for s in sets]})

    wanted = docs.select("doc_id", raw_text()).join(fitting(nodes.select(F.col("node").alias("doc_id")).distinct()), "doc_id", "left_semi")
    found = wanted.mapInPandas(made, "node long, set_id binary, elements binary")
    return found.join(fitting(nodes), ["node", "set_id"], "left_semi")


def similar(percent: int):
    @F.pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            n, m = len(x) // 8, len(y) // 8
            both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
            out.append(100 * both >= percent * (n + m - both))
        return pd.Series(out, dtype=bool)

    return test


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough."""
    pairs = stage(pairs, "pairs")
    ends = stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "set_id"), "node"), "ends")
    sets = stage(sets_of(docs, ends), "sets")
    if sets.count() > ends.count():
        # rows that are repeated as a whole
        sets = stage(sets.dropDuplicates(["node", "set_id"]), "sets")
    left, right = (sets.select(F.col("node").alias(x), F.col("elements").alias(f"set_{x}")) for x in "ab")
    return stage(pairs.join(left, "a").join(right, "b").filter(similar(percent)("set_a", "set_b")).select("a", "b"), "links")


def across(buckets: DataFrame, percent: int) -> DataFrame:
    """All pairs of nodes of different components in one bucket that may link. Large buckets are dealt out in blocks."""
    whole, by_size = Window.partitionBy("token"), Window.partitionBy("token").orderBy("n", "node")
    extent = {"size": F.count("*").over(whole), "low": F.min("component").over(whole), "high": F.max("component").over(whole),
              "before": F.lag("n").over(by_size), "after": F.lead("n").over(by_size)}
    near = (100 * F.col("before") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("after"))
    open_ = buckets.withColumns(extent).filter((F.col("low") < F.col("high")) & near)
    blocks = F.ceil(F.col("size") / BLOCK)
    columns = ("token", "node", "component", "n", "at")
    left = open_.select(*[F.col(c).alias(f"a_{c}") for c in columns], F.pmod(F.xxhash64("node"), blocks).alias("a_block"))
    right = open_.select(*[F.col(c).alias(f"b_{c}") for c in columns], F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("b_block"))
    found = left.join(right, (F.col("a_token") == F.col("b_token")) & (F.col("a_block") == F.col("b_block")) & (F.col("a_component") < F.col("b_component"))
                      & may_link(F.col("a_n"), F.col("a_at"), F.col("b_n"), F.col("b_at"), percent))
    return found.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) for each row of docs."""
    signed = stage(signatures(docs, sketch(docs), percent), "signatures")
    full = signed.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # a group is named by its smallest id, and so are the nodes: one for equal sets
    groups = full.groupBy("group_id").agg(F.min("doc_id").alias("head"), F.first("n").alias("n"), (F.min("set_id") != F.max("set_id")).alias("many"),
                                          F.first("prefix").alias("prefix"))
    nodes = full.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("group_id").alias("group_id"))
    heads = nodes.groupBy("group_id").agg(F.min("node").alias("head"), F.count("*").alias("members"))
    nodes = stage(nodes.join(heads, "group_id").select("set_id", "node", "n", "head", "members"), "nodes")
    postings = groups.select("head", "n", "many", F.posexplode("prefix").alias("at", "token"))
    bucket = Window.partitionBy("token").orderBy("at", "n", "head")
    seen = {"first": F.first(F.struct("head", "n", "at", "many")).over(bucket), "nth": F.row_number().over(bucket),
            "next": F.lead("at").over(bucket), "third": F.lead("at", 2).over(bucket)}
    two = F.when(F.col("nth") == 1, F.col("third").isNull()).otherwise((F.col("nth") == 2) & F.col("next").isNull())
    buckets = stage(postings.withColumns(seen).filter((F.col("nth") > 1) | F.col("next").isNotNull()).withColumn("two", two)
                    .drop("nth", "next", "third", "many"), "buckets")
    inside = nodes.filter("node > head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    outside = first_pairs(buckets, percent).join(nodes.select(F.col("head").alias("b"), "node"), "b").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
    links = verified(docs, nodes, inside.unionByName(outside).filter("a < b").distinct(), percent)
    component = stage(connected_components(links, "a", "b"), "components")
    placed = stage(nodes.join(component, "node", "left").select("head", "members", "node", "n", F.coalesce("component", "node").alias("component")), "placed")
    # the first of a bucket has met all others, so its rest is where three groups meet, or two of which one has members that have not
    wide = buckets.filter("NOT two OR first.many").select("head", "token", "at", F.col("first.head").alias("first"))
    more_rows = (wide.join(placed, "head").filter((F.col("head") != F.col("first")) | (F.col("node") != F.col("head"))).select("token", "at", "n", "node", "component"))
    # the nodes of a group share its first element, in the same place
    same = placed.filter("members > 2 AND node <> head").select(F.xxhash64(F.lit("group"), "head").alias("token"), F.lit(0).alias("at"), "n", "node", "component")
    more = verified(docs, nodes, across(more_rows.unionByName(same), percent), percent)
    if not more.isEmpty():
        component = stage(connected_components(links.unionByName(more), "a", "b"), "components")
    named = nodes.join(component, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    return signed.join(named, "set_id", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
