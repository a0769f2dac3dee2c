"""Language-model scores by logistic context mixing, with a smoothed unigram base.

The model codes the bytes of a text, and one end, bit by bit. Hashed contexts of one to five bytes each predict the next bit from how often
it was 0 and 1 there in the training texts; the predictions are mixed in the logistic domain. A gate picks the mixer's weights: the longest
context that is known, how well, and the place of the bit. Weights are learned online, by gradient steps on the coding cost, each step
predicting what its counts have not seen (an occurrence's own counts are taken out). An adaptive probability map, by the byte before,
refines the mixed prediction. The score of a text is its log10 probability; divided by bits and bytes it gives bits a byte.

All statistics cover all training texts: Spark counts words and byte sequences, and the tables of contexts, the mixer's steps and the map are
made from these counts in tasks. What reaches the driver and every task has a fixed size: the hashed tables, the weights, the map, and the
HOT_WORDS most frequent words; the counts of all other words are joined. A text's score depends on the trained model alone, not on the
order of texts, so any task can be repeated.

Defined results: a null text is empty and has its end only. Without training texts the base is 0 and every bit has probability one half.
Repeated rows and ids each give a row; rows of equal id and text share their sums. Null ids are held out. Only doc_id and text are read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import bucket, pieces
from stratalens.staging import stage

#: Bytes of the longest context, and slots of each context's table as a power of two (one byte needs no hash).
ORDERS, TABLE_BITS = 5, (16, 18, 20, 21, 21)
#: Words whose counts every task holds, at most, and steps in a factor of two by which their least count is found.
HOT_WORDS, HOT_STEPS = 300_000, 4
#: Bytes handled at once, words and sequences a task counts before it sends them on, and sequences for one task of the fit.
CHUNK, HELD, FIT_ROWS = 4_000_000, 300_000, 2_000_000
#: Slots in a row of a table's sums.
BLOCK = 1 << 16
#: Smoothing of a bit's counts, step of the mixer, sequences in a step, passes, and levels of confidence in a gate.
SMOOTH, RATE, STEP, PASSES, LEVELS = 0.3, 0.3, 8192, 3, 4
#: Cells of the map for one byte, over log-odds from -8 to 8.
CELLS = 33
#: The word that stands for the end of a text; words hold no white space.
END = b"\n"

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def sequences(texts: list[bytes]) -> np.ndarray:
    """For each byte of each text and its end (0), the byte with the ORDERS bytes before it as one number; 0 stands before a text."""
    gap = bytes(ORDERS)
    data = np.frombuffer(gap + gap.join(texts) + gap + b"\0" if texts else b"", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.zeros(max(len(data) - ORDERS, 0), np.int64)
    for k in range(ORDERS + 1):
        code = code << 8 | data[k:k + len(code)]
    # the bytes of a text and its end follow the gap before it; the rest of a gap is no symbol
    starts = np.cumsum(sizes + ORDERS) - sizes - ORDERS
    at = np.arange(int((sizes + 1).sum())) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]), sizes + 1)
    return code[at]


def slots(codes: np.ndarray, order: int, bit: int) -> np.ndarray:
    """The slot of an order's context and the bits before this one, for each sequence."""
    node = (1 << bit) | ((codes & 255) >> (8 - bit))
    context = codes >> 8 & ((1 << 8 * order) - 1)
    if order == 1:
        return context << 8 | node
    mixed = (context << 8 | node).astype(np.uint64) * _MULTIPLIERS[order - 1]
    return ((mixed ^ mixed >> np.uint64(29)) * _MULTIPLIERS[0] >> np.uint64(64 - TABLE_BITS[order - 1])).astype(np.int64)


def bits(codes: np.ndarray, bit: int) -> np.ndarray:
    return codes >> (7 - bit) & 1


def log_odds(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    return np.log((ones + SMOOTH) / (zeros + SMOOTH))


def confidence(n: np.ndarray) -> np.ndarray:
    """0 for a context that is unknown, then in steps of a factor of eight."""
    return np.where(n > 0, np.minimum(1 + np.log2(np.maximum(n, 1)) / 3, LEVELS), 0).astype(np.int8)


def gate(levels: np.ndarray, bit: int) -> np.ndarray:
    """The weight set: longest known context (columns of levels are orders), its confidence, and the bit."""
    known = levels > 0
    longest = np.where(known.any(1), levels.shape[1] - known[:, ::-1].argmax(1), 0)
    level = np.where(longest > 0, levels[np.arange(len(levels)), np.maximum(longest, 1) - 1], 1)
    return (longest * LEVELS + level - 1) * 8 + bit


GATES = (ORDERS + 1) * LEVELS * 8


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def map_cell(codes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The map's cell: the byte before, and the mixed log-odds."""
    return (codes >> 8 & 255) * CELLS + np.clip(np.rint((x + 8) * (CELLS - 1) / 16), 0, CELLS - 1).astype(np.int64)


@dataclass
class Model:
    """Log-odds and confidence of each slot, weights of each gate, and the map's probabilities."""

    odds: list[np.ndarray]
    levels: list[np.ndarray]
    weights: np.ndarray
    map: np.ndarray

    def inputs(self, codes: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
        at = [slots(codes, k + 1, bit) for k in range(ORDERS)]
        x = np.stack([self.odds[k][at[k]].astype(np.float32) for k in range(ORDERS)], 1)
        return x, gate(np.stack([self.levels[k][at[k]] for k in range(ORDERS)], 1), bit)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each sequence."""
        total = np.zeros(len(codes))
        for bit in range(8):
            x, g = self.inputs(codes, bit)
            mixed = (self.weights[g] * x).sum(1)
            p = (squash(mixed) + self.map[map_cell(codes, mixed)]) / 2
            total += np.log10(np.where(bits(codes, bit) == 1, p, 1 - p))
        return total


def empty_model() -> Model:
    return Model([np.zeros(1 << b, np.float16) for b in TABLE_BITS], [np.zeros(1 << b, np.int8) for b in TABLE_BITS],
                 np.zeros((GATES, ORDERS), np.float32), np.full(256 * CELLS, 0.5, np.float32))


def raw_text() -> Column:
    return F.coalesce("text", F.lit("")).cast("binary").alias("text")


def counts(training: DataFrame) -> DataFrame:
    """word or sequence (the other is null) with its number of occurrences in the training texts."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, held, size = Counter(), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, n = (np.concatenate(x) for x in zip(*held, strict=True))
            kinds, place = np.unique(codes, return_inverse=True)
            return kinds, np.bincount(place, n).astype(np.int64)

        def sent() -> Iterator[pd.DataFrame]:
            if words:
                yield pd.DataFrame({"word": list(words), "sequence": pd.array([None] * len(words), "Int64"), "n": list(words.values())})
                words.clear()

        for batch in batches:
            texts = batch["text"].tolist()
            for part in pieces([len(x) for x in texts], CHUNK):
                codes = sequences(texts[part])
                kinds, n = np.unique(codes, return_counts=True)
                held.append((kinds, n))
                size += len(kinds)
                if size > 8 * HELD:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size > 6 * HELD:
                        yield pd.DataFrame({"word": None, "sequence": held[0][0], "n": held[0][1]})
                        held.clear()
                        size = 0
                for text in texts[part]:
                    words.update(text.lower().split())
                    if len(words) > HELD:
                        yield from sent()
                words[END] += len(texts[part])
        yield from sent()
        if held:
            kinds, n = merged()
            yield pd.DataFrame({"word": None, "sequence": kinds, "n": n})

    rows = training.select(raw_text()).mapInPandas(counted, "word binary, sequence long, n long")
    return stage(rows.groupBy("word", "sequence").agg(F.sum("n").alias("n")), "lm-counts")


def fit_tables(sequence: DataFrame, tasks: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """How often the bit of each slot was 0 and 1, for each order."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = [np.zeros((2, 1 << b), np.float32) for b in TABLE_BITS]
        for batch in batches:
            codes, n = batch["sequence"].to_numpy(np.int64), batch["n"].to_numpy(np.float32)
            for bit in range(8):
                one = bits(codes, bit)
                for k, table in enumerate(tables):
                    np.add.at(table, (one, slots(codes, k + 1, bit)), n)
        for k, table in enumerate(tables):
            for at in range(0, table.shape[1], BLOCK):
                part = table[:, at:at + BLOCK]
                if part.any():
                    yield pd.DataFrame({"k": [k], "at": [at], "part": [zlib.compress(part.tobytes(), 1)]})

    def total(key: tuple[int, int], rows: pd.DataFrame) -> pd.DataFrame:
        part = sum(np.frombuffer(zlib.decompress(x), np.float32).astype(np.float64) for x in rows["part"])
        # ratios and small counts matter, and both survive half precision once large counts are scaled down
        both = part.reshape(2, -1)
        both = both / np.maximum(both.max(0) / 30_000, 1)
        return pd.DataFrame({"k": [key[0]], "at": [key[1]], "part": [zlib.compress(both.astype(np.float16).tobytes(), 1)]})

    schema = "k int, at int, part binary"
    rows = sequence.coalesce(tasks).mapInPandas(summed, schema).groupBy("k", "at").applyInPandas(total, schema).collect()
    tables = [(np.zeros(1 << b, np.float16), np.zeros(1 << b, np.float16)) for b in TABLE_BITS]
    for r in rows:
        part = np.frombuffer(zlib.decompress(r["part"]), np.float16).reshape(2, -1)
        for one in (0, 1):
            tables[r["k"]][one][r["at"]:r["at"] + part.shape[1]] = part[one]
    return tables


def unseen(tables: list[tuple[np.ndarray, np.ndarray]], codes: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds and confidence of each order as they were without one occurrence of the sequence itself."""
    one, x, levels = bits(codes, bit), [], []
    for k, (zeros, ones) in enumerate(tables):
        at = slots(codes, k + 1, bit)
        n0, n1 = zeros[at].astype(np.float32), ones[at].astype(np.float32)
        n0, n1 = np.maximum(n0 - (one == 0), 0), np.maximum(n1 - (one == 1), 0)
        x.append(log_odds(n1, n0))
        levels.append(confidence(n0 + n1))
    return np.stack(x, 1), np.stack(levels, 1)


def shuffled(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Steps of sequences and their counts; a batch is gone through in the order of a hash of its sequences."""
    for batch in batches:
        codes, n = batch["sequence"].to_numpy(np.int64), batch["n"].to_numpy(np.float64)
        order = np.argsort(codes.astype(np.uint64) * _MULTIPLIERS[1], kind="stable")
        for at in range(0, len(codes), STEP):
            yield codes[order[at:at + STEP]], n[order[at:at + STEP]]


def fit_weights(sequence: DataFrame, tasks: int, tables) -> np.ndarray:
    """Mixer weights: online gradient steps in each task, then the mean over tasks by how much each gate has coded there."""

    def learned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, mass, steps = np.full((GATES, ORDERS), 1 / 3), np.zeros(GATES), np.zeros(GATES)
        for codes, n in shuffled(batches):
            for bit in range(8):
                x, levels = unseen(tables.value, codes, bit)
                g, one = gate(levels, bit), bits(codes, bit)
                own = np.bincount(g, n, GATES)
                mass += own
                steps += own > 0
                for _ in range(PASSES):
                    miss = (one - squash((weights[g] * x).sum(1))) * n
                    for k in range(ORDERS):
                        weights[:, k] += RATE / np.sqrt(1 + steps / 20) * np.bincount(g, miss * x[:, k], GATES) / np.maximum(own, 1)
        yield pd.DataFrame({"gate": np.arange(GATES), "mass": mass, "weights": list(weights)})

    rows = sequence.coalesce(tasks).mapInPandas(learned, "gate int, mass double, weights array<double>").collect()
    total, mass = np.zeros((GATES, ORDERS)), np.zeros(GATES)
    for r in sorted(rows, key=lambda r: (r["gate"], r["mass"])):
        total[r["gate"]] += np.array(r["weights"]) * r["mass"]
        mass[r["gate"]] += r["mass"]
    return np.where(mass[:, None] > 0, total / np.maximum(mass, 1)[:, None], 1 / 3).astype(np.float32)


def fit_map(sequence: DataFrame, tasks: int, tables, weights: np.ndarray) -> np.ndarray:
    """For each byte before and mixed log-odds how often the bit was 1, drawn towards the mixed prediction."""

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits, n_all = np.zeros(256 * CELLS), np.zeros(256 * CELLS)
        for codes, n in shuffled(batches):
            for bit in range(8):
                x, levels = unseen(tables.value, codes, bit)
                cell = map_cell(codes, (weights[gate(levels, bit)] * x).sum(1))
                hits += np.bincount(cell, n * bits(codes, bit), len(hits))
                n_all += np.bincount(cell, n, len(hits))
        yield pd.DataFrame({"cell": np.arange(len(hits)), "hits": hits, "n": n_all})

    rows = sequence.coalesce(tasks).mapInPandas(seen, "cell int, hits double, n double").groupBy("cell").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect()
    middle = squash(np.tile(np.linspace(-8, 8, CELLS), 256))
    hits, n = np.zeros(256 * CELLS), np.zeros(256 * CELLS)
    for r in rows:
        hits[r["cell"]], n[r["cell"]] = r["hits"], r["n"]
    return np.clip((hits + 20 * middle) / (n + 20), 1e-6, 1 - 1e-6).astype(np.float32)


def fit(counted: DataFrame) -> Model:
    """The model from the staged counts."""
    sequence = counted.filter("sequence IS NOT NULL").select("sequence", "n")
    size = sequence.count()
    if not size:
        return empty_model()
    context, tasks = counted.sparkSession.sparkContext, max(1, -(-size // FIT_ROWS))
    found = fit_tables(sequence, tasks)
    tables = context.broadcast(found)
    weights = fit_weights(sequence, tasks, tables)
    refined = fit_map(sequence, tasks, tables, weights)
    tables.destroy()
    model = Model([], [], weights, refined)
    for zeros, ones in found:
        zeros, ones = zeros.astype(np.float32), ones.astype(np.float32)
        model.odds.append(log_odds(ones, zeros).astype(np.float16))
        model.levels.append(confidence(zeros + ones))
    return model


def hot_words(words: DataFrame, most: int) -> list[tuple[bytes, bytes]]:
    """The most frequent words, as many steps of frequency as hold at most so many: words joined by line feeds, with their counts."""
    step = F.floor(F.log2("n") * HOT_STEPS)
    words = words.filter(F.col("word") != END)
    # as many rows as a long has steps
    total, least = 0, None
    for row in sorted(words.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        total += row["count"]
        if total > most:
            break
        least = row["step"]

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"words": [b"\n".join(batch["word"])], "counts": [batch["n"].to_numpy(np.int64).tobytes()]})

    if least is None:
        return []
    return [(bytes(r["words"]), bytes(r["counts"])) for r in words.filter(step >= least).mapInPandas(packed, "words binary, counts binary").collect()]


SCORED = "doc_id long, _key long, held_out boolean, n_words long, hot_known long, hot_sum double, score double, rare array<struct<word: binary, n: long>>"


def scored(docs: DataFrame, model: Model, hot: list[tuple[bytes, bytes]]) -> DataFrame:
    """For each text its model score, the sums over its hot words, and its other words with their numbers."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((model, hot))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, hot = shared.value
        known_words = [w for words, _ in hot for w in words.split(b"\n")]
        place = dict(zip(known_words, range(len(known_words)), strict=True))
        logs = np.log10(np.concatenate([np.frombuffer(n, np.int64) for _, n in hot] or [np.zeros(0)]) + 0.1)
        for batch in batches:
            texts = batch["text"].tolist()
            for part in pieces([len(x) for x in texts], CHUNK):
                own = texts[part]
                number, codes = pd.factorize(sequences(own))
                ends = np.cumsum([len(x) + 1 for x in own])
                total = np.add.reduceat(model.log10(codes)[number], np.concatenate([[0], ends[:-1]]))
                rows = []
                for text in own:
                    words = text.lower().split()
                    at = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))
                    known = at >= 0
                    rare = Counter([words[i] for i in np.flatnonzero(~known)])
                    rows.append((len(words), int(known.sum()), float(logs[at[known]].sum()), [{"word": w, "n": n} for w, n in rare.items()]))
                yield pd.concat([batch.iloc[part][["doc_id", "_key", "held_out"]].reset_index(drop=True),
                                 pd.DataFrame(rows, columns=["n_words", "hot_known", "hot_sum", "rare"]), pd.Series(total, name="score")], axis=1).astype({"doc_id": "Int64"})

    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_key"), (bucket("doc_id", 10) == 0).alias("held_out"), raw_text())
    return rows.mapInPandas(lambda batches: (x[[c.split(" ")[0] for c in SCORED.split(", ")[:8]]] for x in each(batches)), SCORED)


def scores(docs: DataFrame) -> DataFrame:
    """Base and model score of each document; learned where crc32(doc_id) mod 10 is not 0."""
    counted = counts(docs.filter(bucket("doc_id", 10) != 0))
    words = counted.filter("word IS NOT NULL").select("word", "n")
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("kinds")).first()
    ends = words.filter(F.col("word") == END).first()
    end = ends["n"] if ends else 0
    each = math.log10(size["tokens"] + 0.1 * (size["kinds"] + 1))
    found = stage(scored(docs, fit(counted), hot_words(words, HOT_WORDS)), "lm-scored")
    rare = found.select("doc_id", "_key", F.explode("rare").alias("w")).select("doc_id", "_key", "w.word", "w.n").distinct()
    rare = rare.join(words.withColumnRenamed("n", "c"), "word", "left").groupBy("doc_id", "_key").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("sum"))
    rare = rare.withColumnsRenamed({"doc_id": "_doc", "_key": "_text"})
    both = found.drop("rare").join(rare, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_text")), "left")
    base = F.col("hot_sum") + F.coalesce("sum", F.lit(0.0)) + math.log10(end + 0.1) - (F.col("n_words") + 1) * each
    return both.select("doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"),
                       (F.col("hot_known") + F.coalesce("known", F.lit(0)) + (1 if end else 0)).cast("long").alias("n_known"),
                       F.lit(size["tokens"]).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
