"""Language identification by rank-order profiles of n-grams.

A profile lists a language's most frequent letter n-grams (one to three letters of lower-cased words, with word edges) by falling count.
A document is ranked the same way, and its language is the one whose ranks are the least out of place. Training counts cover every
document with a language; only the profiles, at most `size` n-grams a language, reach the driver and the tasks.

Defined results: a null text, or one without letters, is `und` with score 0; a null language teaches nothing; without any training text
every document is `und`. Ties go to the language that sorts first. Repeated rows and repeated ids each give a row. Other columns of the
input may have any names: only text and lang are read, and the columns added here replace those of the same name.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stratalens.llm.common import bucket, pieces, tidied, unused

#: n-grams in a profile, and in the ranking of a document.
PROFILE = 400
#: Letters handled at once, so that a task's arrays stay small whatever the length of a text.
CHUNK = 400_000
#: Bits of an n-gram's code in a sort key.
CODE_BITS = 30
#: Languages that a label column may name; more than that is no language column.
MOST_LANGUAGES = 5_000

RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def letter_stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words of all texts, 0 at each edge of a word, and the number of the text that each belongs to."""
    lowered = [x.lower() for x in texts]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1
    points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(lowered), dtype=np.int64), lengths)
    points = np.where(letters()[points], points, 0)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
    points, owner = points[keep], owner[keep]
    # a leading edge for each text: the last edge of the text before it, and one for the first
    return np.concatenate([[0], points]).astype(np.int64), np.concatenate([[0], owner])


def gram_codes(symbols: np.ndarray, base: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For one, two and three symbols: positions of the last symbol and codes below base + base**2 + base**3."""
    a, b, c = symbols[:-2], symbols[1:-1], symbols[2:]
    one = np.flatnonzero(symbols)
    two = np.flatnonzero((symbols[1:] != 0) | (symbols[:-1] != 0)) + 1
    three = np.flatnonzero(b) + 2
    return [(one, symbols[one]), (two, base + symbols[two - 1] * base + symbols[two]),
            (three, base + base * base + (a[three - 2] * base + b[three - 2]) * base + c[three - 2])]


def count_grams(texts: list[str]) -> dict[str, int]:
    """How often each n-gram occurs in the texts; an edge is written as a space."""
    points, _ = letter_stream(texts)
    alphabet, symbols = np.unique(points, return_inverse=True)
    if alphabet[0] != 0:
        alphabet, symbols = np.concatenate([[0], alphabet]), symbols + 1
    base, found = len(alphabet), {}
    char = [" ", *map(chr, alphabet[1:])]
    for n, (_, codes) in enumerate(gram_codes(symbols, base), 1):
        if base**3 <= 1 << 22:
            counts = np.bincount(codes)
            kinds = np.flatnonzero(counts)
            counts = counts[kinds]
        else:
            kinds, counts = np.unique(codes, return_counts=True)
        rest = kinds - sum(base**k for k in range(1, n))
        for k, m in zip(rest.tolist(), counts.tolist(), strict=True):
            gram = ""
            for _ in range(n):
                gram, k = char[k % base] + gram, k // base
            found[gram] = m
    return found


def profiles(docs: DataFrame, size: int = PROFILE) -> dict[str, list[str]]:
    """The most frequent n-grams of each language of docs (text, lang), in order; ties by n-gram."""

    @tidied
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, rows in batch.groupby("lang", sort=True):
                texts = rows["text"].tolist()
                for part in pieces([len(x) for x in texts], CHUNK):
                    grams = count_grams(texts[part])
                    yield pd.DataFrame({"lang": lang, "gram": list(grams), "n": list(grams.values())})

    counts = (docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
              .mapInPandas(counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size).groupBy("lang").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "gram"))), lambda x: x["gram"]).alias("grams"))
    rows = ranked.limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"lang has over {MOST_LANGUAGES} values")
    return {r["lang"]: r["grams"] for r in sorted(rows, key=lambda r: r["lang"])}


class Profiles:
    """Profiles as arrays: sorted n-gram codes, and each language's rank for each (size of the profile where it has none)."""

    def __init__(self, grams: dict[str, list[str]], size: int = PROFILE):
        self.langs, self.size = list(grams), size
        self.alphabet = sorted({c for g in grams.values() for x in g for c in x if c != " "})
        # 0 is an edge, the last symbol any letter that no profile has
        self.base = len(self.alphabet) + 2
        self.symbol = np.full(sys.maxunicode + 1, self.base - 1, np.int64)
        self.symbol[0] = 0
        self.symbol[[ord(c) for c in self.alphabet]] = np.arange(1, self.base - 1)
        code = {g: self.code(g) for gs in grams.values() for g in gs}
        self.codes = np.array(sorted(set(code.values())), np.int64)
        place = {c: i for i, c in enumerate(self.codes.tolist())}
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), size, np.int32)
        self.known = np.zeros((len(self.codes) + 1, len(self.langs)), bool)
        for j, gs in enumerate(grams.values()):
            for r, g in enumerate(gs):
                self.ranks[place[code[g]], j] = r
                self.known[place[code[g]], j] = True

    def code(self, gram: str) -> int:
        value = 0
        for c in gram:
            value = value * self.base + (0 if c == " " else int(self.symbol[ord(c)]))
        return (sum(self.base**k for k in range(1, len(gram))) + value) % (1 << CODE_BITS)

    def ranked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, n-gram code and rank of the most frequent n-grams of each text; ties by code."""
        points, owner = letter_stream(texts)
        symbols = self.symbol[points]
        keys = np.concatenate([owner[at] << CODE_BITS | codes % (1 << CODE_BITS) for at, codes in gram_codes(symbols, self.base)])
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        counts = np.diff(first, append=len(keys))
        text, codes = keys[first] >> CODE_BITS, keys[first] & ((1 << CODE_BITS) - 1)
        # stable, so codes stay in order among equal counts
        codes = codes[np.lexsort((-counts, text))]
        starts = np.flatnonzero(np.diff(text, prepend=-1))
        rank = np.arange(len(text)) - np.repeat(starts, np.diff(starts, append=len(text)))
        top = rank < self.size
        return text[top], codes[top], rank[top]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        text, codes, rank = self.ranked(texts)
        at = np.searchsorted(self.codes, codes)
        at = np.where(self.codes[np.minimum(at, len(self.codes) - 1)] == codes, at, len(self.codes))
        away = np.where(self.known[at], np.abs(self.ranks[at] - rank[:, None].astype(np.int32)), self.size)
        n = np.bincount(text, minlength=len(texts))
        total = np.stack([np.bincount(text, away[:, j], len(texts)) for j in range(len(self.langs))], 1)
        best = total.argmin(1)
        score = 1 - total[np.arange(len(texts)), best] / (self.size * np.maximum(n, 1))
        return [self.langs[b] if k else "und" for b, k in zip(best, n, strict=True)], np.where(n > 0, np.clip(score, 0, 1), 0.0)


def predictor(grams: dict[str, list[str]], size: int = PROFILE):
    """A column function from text to (lang_pred, score)."""
    built: list[Profiles] = []

    @F.pandas_udf(RESULT)
    @tidied
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not built and grams:
            built.append(Profiles(grams, size))
        for batch in batches:
            texts, langs, scores = batch.fillna("").tolist(), [], []
            # one more for each text, so that empty ones are bounded too
            for part in pieces([len(x) + 1 for x in texts], CHUNK):
                lang, score = built[0].predict(texts[part]) if grams else (["und"] * len(texts[part]), np.zeros(len(texts[part])))
                langs += lang
                scores.append(score)
            yield pd.DataFrame({"lang_pred": langs, "score": np.concatenate(scores) if scores else []})

    return predict


def identify(docs: DataFrame, training: Column, size: int = PROFILE) -> DataFrame:
    """docs with lang_pred and score, learned from the rows where training is true."""
    predict = predictor(profiles(docs.filter(training), size), size)
    found = predict(F.col("text"))
    at = unused(docs, "_found")
    return docs.withColumn(at, found).withColumns({"lang_pred": F.col(at)["lang_pred"], "score": F.col(at)["score"]}).drop(at)


def in_known_language(docs: DataFrame, training: Column, size: int = PROFILE) -> DataFrame:
    """The rows of docs in which a language can be told, learned from the rows where training is true; columns stay as they are."""
    predict, at = predictor(profiles(docs.filter(training), size), size), unused(docs, "_found")
    return docs.withColumn(at, predict(F.col("text"))).filter(F.col(at)["lang_pred"] != "und").drop(at)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document; learned where crc32(doc_id) mod 3 is not 1."""
    held = bucket("doc_id", 3) == 1
    return identify(docs.select("doc_id", "text", "lang"), ~held).select("doc_id", held.alias("held_out"), "lang_pred", "score")
