"""Toxicity by maximum-scoring segments of token log-odds.

A word's log-odds between toxic and clean training texts has an informative Dirichlet prior from both together. A word counts if it is
commoner in toxic texts and the root of its likelihood ratio statistic exceeds what the largest of as many standard normal draws as there
are words would reach, sqrt(2 ln words). A text counts once for a word, as words come in bursts, and equal texts count once. All other tokens share one negative score. A linear scan finds every maximal-scoring segment (Ruzzo and Tompa). As in Karlin and Altschul's theory of such segments, a
score S in n tokens is expected by chance n exp(-lambda S) times, where lambda solves sum p exp(lambda s) = 1 over clean tokens; the
evidence of a text is the sum of lambda S - ln n over its significant segments, those where this is positive. A logistic curve
over the evidence of the labelled training texts gives the score.

The counts and the curve cover all labelled training rows. Words that count are sent to the tasks, MOST_WORDS at most, the most
significant: this bounds the classifier and is its only limit.

Defined results: a null or empty text has no evidence and gets the curve's value at 0. Without labelled rows of both classes no word
counts, and every score is the share of toxic ones among those there are, 0 if none. Repeated labels of an id count as toxic if one of them
is. Only doc_id and text are read, and doc_id and toxic of labels.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.llm.common import bucket, fitting
from stratalens.staging import stage

#: Weight of the prior as a share of all texts, and words of a model.
PRIOR, MOST_WORDS = 0.1, 100_000
#: Score of a token that doesn't count; a passage ends where these outweigh what follows.
NEUTRAL = -0.2
#: Width of a bin of evidence in the fit, and the evidence from which all is one bin.
BIN, MOST_EVIDENCE = 0.25, 100.0
#: What is taken off both ends of a word.
AROUND = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Distinct words that a task counts before it sends them on.
HELD_WORDS = 300_000

RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("evidence", T.DoubleType()), T.StructField("passages", T.ArrayType(
    T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("score", T.DoubleType())])))])


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, without ASCII punctuation around them."""
    return [w.strip(AROUND) for w in text.encode().lower().split()]


@dataclass
class Model:
    """weight: log-odds of each word that counts; neutral: score of other tokens; rate: lambda; curve: intercept and slope."""

    weight: dict[bytes, float] = field(default_factory=dict)
    neutral: float = NEUTRAL
    rate: float = 1.0
    curve: tuple[float, float] = (-math.inf, 0.0)

    def segments(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """All maximal segments: first and last token and score, found in one pass over the tokens that score above the neutral."""
        weight, found, stack = self.weight, [], []
        at = [(i, weight[w]) for i, w in enumerate(words) if w in weight]
        # stack: first, last, sum before the segment, sum up to its end
        total, before = 0.0, -1
        for i, s in at:
            left = total + self.neutral * (i - before - 1)
            total, before = left + s, i
            item = (i, i, left, total)
            while True:
                k = len(stack) - 1
                while k >= 0 and stack[k][2] >= item[2]:
                    k -= 1
                if k < 0 or stack[k][3] >= item[3]:
                    if k < 0:
                        # nothing to the left can join any more: all on the stack is final
                        found += stack
                        stack = []
                    stack.append(item)
                    break
                item = (stack[k][0], i, stack[k][2], total)
                del stack[k:]
        return [(a, b, end - start) for a, b, start, end in [*found, *stack]]

    def evidence(self, words: list[bytes]) -> tuple[float, list[tuple[int, int, float]]]:
        """The text's evidence and its significant segments."""
        n = math.log(max(len(words), 1))
        significant = [(a, b, s) for a, b, s in self.segments(words) if self.rate * s > n]
        return sum(self.rate * s - n for _, _, s in significant), significant

    def score(self, evidence: float) -> float:
        x = self.curve[0] + self.curve[1] * min(evidence, MOST_EVIDENCE)
        return 0.0 if x == -math.inf else 1 / (1 + math.exp(-max(min(x, 500), -500)))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic (0 or 1) of the training rows."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return docs.select("doc_id", "text").filter(bucket("doc_id", 3) != 1).join(fitting(known), "doc_id").groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("toxic").alias("toxic"))


COUNTS = "word binary, clean long, toxic long, tokens long"


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Clean and toxic texts with each word, and how often it occurs in the clean ones, as far as held at once. A null word counts all."""
    held = {}

    def sent() -> pd.DataFrame:
        return pd.DataFrame([(u, *n) for u, n in held.items()], columns=["word", "clean", "toxic", "tokens"])

    for batch in batches:
        for text, toxic in batch[["text", "toxic"]].itertuples(index=False):
            found = Counter(tokens(text))
            found[None] = found.total()
            for u, n in found.items():
                entry = held.setdefault(u, [0, 0, 0])
                entry[toxic > 0] += 1
                entry[2] += 0 if toxic > 0 else n
            if len(held) > HELD_WORDS:
                yield sent()
                held.clear()
    if held:
        yield sent()


def fit_words(training: DataFrame) -> Model:
    """The words that count, their log-odds, and lambda."""
    sums = [F.sum(c).alias(c) for c in ("clean", "toxic", "tokens")]
    by_word = stage(training.mapInPandas(counted, COUNTS).groupBy("word").agg(*sums), "words")
    size, kinds = by_word.filter("word IS NULL").first(), by_word.count()
    if not size or not size["clean"] or not size["toxic"]:
        return Model()
    n_c, n_t, c, t = size["clean"], size["toxic"], F.col("clean"), F.col("toxic")
    a0, a = PRIOR * (n_c + n_t), PRIOR * (c + t)
    odds = F.log((t + a) / (n_t + a0 - t - a + 0.5)) - F.log((c + a) / (n_c + a0 - c - a + 0.5))
    # expected texts if the word were as common in both; the statistic is 2 sum observed ln(observed / expected)
    e_t, e_c = (c + t) * (n_t / (n_c + n_t)), (c + t) * (n_c / (n_c + n_t))
    root = F.sqrt(2 * (F.when(t > 0, t * F.log(t / e_t)).otherwise(0) + F.when(c > 0, c * F.log(c / e_c)).otherwise(0)))
    bar = math.sqrt(2 * math.log(max(kinds, 2)))
    rows = (by_word.filter("word IS NOT NULL").filter(t > e_t).select("word", "tokens", odds.alias("odds"), root.alias("root")).filter(F.col("root") > bar)
            .filter("odds > 0").orderBy(F.desc("root"), "word").limit(MOST_WORDS).collect())
    weight = {bytes(r["word"]): r["odds"] for r in rows}
    if not weight:
        return Model()
    share = [(max(r["tokens"], 0.5) / max(size["tokens"], 1), r["odds"]) for r in rows]
    return Model(weight, NEUTRAL, decay(share, NEUTRAL))


def decay(share: list[tuple[float, float]], neutral: float) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1; the p of scored tokens are given, the rest is neutral."""
    rest = max(1 - sum(p for p, _ in share), 1e-9)

    def total(x: float) -> float:
        return sum(p * math.exp(min(x * s, 700)) for p, s in share) + rest * math.exp(x * neutral) - 1

    low, high = 1e-6, 1.0
    while total(high) < 0 and high < 1e3:
        low, high = high, high * 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < 0 else (low, middle)
    return low


def fit_curve(model: Model, training: DataFrame) -> Model:
    """The logistic curve over bins of evidence, with a weak pull of the slope towards 1."""

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: model.evidence(tokens(x))[0]).astype(float)

    at = F.round(F.least(evidence("text"), F.lit(MOST_EVIDENCE)) / BIN).cast("int")
    rows = training.select(at.alias("at"), F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic")).groupBy("at").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("toxic")).collect()
    if not rows:
        return model
    x, n, y = (np.array([float(r[k]) for r in rows]) for k in ("at", "n", "toxic"))
    x *= BIN
    share = float(y.sum() / n.sum())
    if not 0 < share < 1:
        return Model(model.weight, model.neutral, model.rate, (math.inf if share else -math.inf, 0.0))
    design, beta = np.stack([np.ones_like(x), x], 1), np.array([math.log(share / (1 - share)), 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - n * p) - np.array([0.0, beta[1] - 1])
        beta = beta + np.clip(np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + np.diag([1e-6, 1.0]), gradient), -2, 2)
    return Model(model.weight, model.neutral, model.rate, (float(beta[0]), max(float(beta[1]), 0.0)))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    training = stage(labelled(docs, labels), "labelled")
    return fit_curve(fit_words(training), training)


def scorer(model: Model):
    """A column function from text to its score, evidence and significant passages (first and last word)."""

    @F.pandas_udf(RESULT)
    def score(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            evidence, found = model.evidence(tokens(text or ""))
            rows.append((model.score(evidence), evidence, [{"first": a, "last": b, "score": s} for a, b, s in found]))
        return pd.DataFrame(rows, columns=["score", "evidence", "passages"])

    return score


def judged(docs: DataFrame, model: Model, text: Column | None = None) -> DataFrame:
    """doc_id with score, predicted, evidence and passages."""
    found = docs.select("doc_id", scorer(model)(F.col("text") if text is None else text).alias("s"))
    return found.select("doc_id", (bucket("doc_id", 3) == 1).alias("held_out"), "s.score", F.when(F.col("s.score") >= 0.7, 1).otherwise(0).alias("predicted"),
                        "s.evidence", "s.passages")
