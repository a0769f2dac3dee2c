"""Quality rules: counts of a text's words, and labels of its lines by a linear-chain conditional random field.

Each line with a word has features: MEASURES of it (length, symbols, capitals, how it ends, repeated words, ...), each as the bin it falls
into. The field scores a sequence of labels by weights of label and bin, of two labels next to each other, and of the first label. Viterbi
decoding finds the best sequence of content and boilerplate. A text is kept if it passes the fixed rules and at least KEPT_SHARE of the
characters of its words stand in content lines.

The field is fitted to a bounded sample of labelled rows, SAMPLE documents of up to SAMPLE_LINES lines, chosen by a hash of the id; only
their bins go to the driver. All lines of a good document count as content. Those of a bad one count as boilerplate if their bins, taken as
independent, are commoner in bad documents than in good ones, and so does in any case the line for which this is clearest. Weights maximise
the penalised conditional likelihood, by gradients from forward and backward sums.

Defined results: a null or empty text has no words and fails. Without good and bad labelled rows, every line is content. Repeated labels of
an id count as good only if all do. Repeated rows are judged one by one. A line of equal weight for both labels is content. Labels are read by
doc_id and quality, documents by doc_id and text; other columns have no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.llm.common import bucket, fitting
from stratalens.staging import stage

#: Documents of the sample, and lines that one of them may have.
SAMPLE, SAMPLE_LINES = 4_000, 100
#: Share of the words' characters in content lines from which a text is kept.
KEPT_SHARE = 0.5
#: Fixed rules: least words, most percent of words in repeated windows, words of a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
#: Penalty of the weights, steps of the fit and their size.
PENALTY, STEPS, RATE = 0.01, 150, 0.1

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Upper ends of the bins of each measure of a line.
MEASURES: dict[str, tuple[float, ...]] = {
    "words": (1, 3, 7, 15, 31), "symbols a word": (0, 0.1, 0.4), "capitals a letter": (0.05, 0.15, 0.4, 0.7), "ends as": (0, 1, 2),
    "exclamations a word": (0, 0.1, 0.5), "words like the one before": (0, 0.1, 0.4), "words in repeated windows": (0, 0.3, 0.8),
    "digits a character": (0, 0.05, 0.2), "characters a word": (3, 5, 7, 10, 16), "seen before": (0,), "stops a word": (0, 0.05, 0.2, 0.5),
    "commas a word": (0, 0.1, 0.3)}
STARTS = np.cumsum([0, *[len(ends) + 1 for ends in MEASURES.values()]])
BINS = int(STARTS[-1])

#: Kinds of characters, as bits.
WHITE, LETTER, UPPER, DIGIT, SYMBOL, STOP, COMMA, EXCLAMATION = (1 << i for i in range(8))
KNOWN_CHARS = 0x30000

RESULT = T.StructType([*[T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_chars")],
                       T.StructField("content_lines", T.ArrayType(T.IntegerType()))])


@cache
def kinds() -> np.ndarray:
    """The kinds of each character; those beyond the table have none."""
    out = np.zeros(KNOWN_CHARS + 1, np.uint8)
    for c in range(KNOWN_CHARS):
        x = chr(c)
        out[c] = LETTER * x.isalpha() | UPPER * x.isupper() | DIGIT * x.isdigit()
    for chars, kind in (("\t\n\x0b\x0c\r ", WHITE), (SYMBOLS, SYMBOL), (".!?", STOP), (",;:", COMMA), ("!", EXCLAMATION)):
        for x in chars:
            out[ord(x)] |= kind
    return out


def repeated(ids: np.ndarray) -> np.ndarray:
    """Which words stand in a window of WINDOW words (a power of two) that is found twice or more."""
    covered = np.zeros(len(ids) + 1, np.int64)
    n, rank, width = len(ids), ids, 1
    if n <= WINDOW:
        return covered[:n] > 0
    while width < WINDOW:
        # a window of twice the width is a pair of windows
        rank = np.unique(rank[:-width] * n + rank[width:], return_inverse=True)[1]
        width *= 2
    again = np.flatnonzero(np.bincount(rank)[rank] > 1)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + WINDOW, -1)
    return np.cumsum(covered)[:n] > 0


@dataclass
class Text:
    """Counts of a text, and of each line with a word its number, the characters of its words and its bins."""

    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    lines: np.ndarray = None
    chars: np.ndarray = None
    bins: np.ndarray = None


def read_text(text: str | None) -> Text:
    words = WORD.findall(text or "")
    if not words:
        return Text(lines=np.zeros(0, np.int64), chars=np.zeros(0, np.int64), bins=np.zeros((0, len(MEASURES)), np.uint8))
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    again = repeated(ids)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = kinds()[np.minimum(points, KNOWN_CHARS)]
    black = kind & WHITE == 0
    first = black & np.concatenate([[True], ~black[:-1]])
    starts = np.concatenate([[0], np.flatnonzero(points == 10) + 1])
    # a line's sums run up to the next line's start; a last line without characters has none
    starts = starts[starts < len(points)]

    def total(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, starts, dtype=np.int64)

    n = total(first)
    of = np.flatnonzero(n)
    line = np.repeat(np.arange(len(n)), n)
    same = np.concatenate([[False], (ids[1:] == ids[:-1]) & (line[1:] == line[:-1])])
    chars, letters = total(black), total(kind & LETTER > 0)
    symbols, digits = total(kind & SYMBOL > 0), total(kind & DIGIT > 0)
    seen, dup = set(), np.zeros(len(n), np.int64)
    texts = text.split("\n")
    for i in of:
        dup[i] = texts[i] in seen
        seen.add(texts[i])
    ends = np.append(starts[1:], len(points)) - 1
    black_at = np.maximum.accumulate(np.where(black, np.arange(len(points)), 0))
    last = kind[black_at[ends]]
    how = np.where(last & STOP, 0, np.where(last & (LETTER | DIGIT), 1, np.where(last & SYMBOL, 2, 3)))
    per = np.maximum(n, 1)
    values = [n, symbols / per, total(kind & UPPER > 0) / np.maximum(letters, 1), how, total(kind & EXCLAMATION > 0) / per, np.bincount(line, same, len(n)) / per,
              np.bincount(line, again, len(n)) / per, digits / np.maximum(chars, 1), chars / per, dup, total(kind & STOP > 0) / per, total(kind & COMMA > 0) / per]
    bins = np.stack([np.searchsorted(ends, v[of], "left") for ends, v in zip(MEASURES.values(), values, strict=True)], 1).astype(np.uint8)
    return Text(len(words), int(chars.sum()), int(symbols.sum()), int(dup.sum()), int(again.sum()), of, chars[of], bins)


@dataclass
class Field:
    """Weights of label and bin, of a label after another, and of the first label; label 1 is boilerplate."""

    bins: np.ndarray
    after: np.ndarray
    first: np.ndarray

    def scores(self, bins: np.ndarray) -> np.ndarray:
        """Of each line and label."""
        return self.bins[bins.astype(np.int64) + STARTS[:-1]].sum(1)

    def labels(self, bins: np.ndarray) -> list[int]:
        """Viterbi decoding."""
        if not len(bins):
            return []
        rows = self.scores(bins).tolist()
        (cc, cb), (bc, bb) = self.after.tolist()
        content, boilerplate = rows[0][0] + self.first[0], rows[0][1] + self.first[1]
        back = []
        for own_c, own_b in rows[1:]:
            from_c, from_b = content + cc >= boilerplate + bc, content + cb >= boilerplate + bb
            back.append((0 if from_c else 1, 0 if from_b else 1))
            content, boilerplate = own_c + (content + cc if from_c else boilerplate + bc), own_b + (content + cb if from_b else boilerplate + bb)
        out = [0 if content >= boilerplate else 1]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def expectations(field: Field, bins: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The sum of log partition functions, and expected labels of lines, of first lines and of pairs; texts stand from long to short."""
    starts = np.cumsum(lengths) - lengths
    scores = field.scores(bins)
    forward, backward = np.empty_like(scores), np.zeros_like(scores)
    most = int(lengths.max())
    alive = [int(np.searchsorted(-lengths, -t, "left")) for t in range(most)]  # texts longer than t
    forward[starts] = scores[starts] + field.first
    for t in range(1, most):
        at = starts[:alive[t]] + t
        forward[at] = scores[at] + np.logaddexp.reduce(forward[at - 1][:, :, None] + field.after, 1)
    for t in range(most - 1, 0, -1):
        at = starts[:alive[t]] + t
        backward[at - 1] = np.logaddexp.reduce(field.after + (scores[at] + backward[at])[:, None, :], 2)
    logs = np.logaddexp.reduce(forward[starts + lengths - 1], 1)
    of = np.repeat(np.arange(len(lengths)), lengths)
    share = np.exp(forward + backward - logs[of, None])
    inner = np.ones(len(bins), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    pairs = np.exp(forward[at - 1][:, :, None] + field.after + (scores[at] + backward[at])[:, None, :] - logs[of[at], None, None]).sum(0)
    return float(logs.sum()), share, share[starts].sum(0), pairs


def counted(labels: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Sums over lines of the weight of each label, by bin."""
    places = (bins.astype(np.int64) + STARTS[:-1]).reshape(-1)
    return np.stack([np.bincount(places, np.repeat(labels[:, label], bins.shape[1]), BINS) for label in (0, 1)], 1)


def fit_field(good: list[np.ndarray], bad: list[np.ndarray]) -> Field | None:
    """The field for the lines' bins of good and bad texts; none if one of them is missing."""
    good, bad = [b for b in good if len(b)], [b for b in bad if len(b)]
    if not good or not bad:
        return None
    # how much commoner a line's bins are in bad texts
    odds = [np.log(counted(np.ones((sum(map(len, x)), 2)), np.concatenate(x))[:, 0] + 0.5) - np.log(sum(map(len, x))) for x in (good, bad)]
    texts = [(b, np.zeros(len(b), np.int64)) for b in good]
    for b in bad:
        clear = (odds[1] - odds[0])[b.astype(np.int64) + STARTS[:-1]].sum(1)
        label = (clear > 0).astype(np.int64)
        label[clear.argmax()] = 1
        texts.append((b, label))
    texts.sort(key=lambda x: -len(x[0]))
    bins, labels, lengths = np.concatenate([b for b, _ in texts]), np.concatenate([y for _, y in texts]), np.array([len(b) for b, _ in texts])
    starts = np.cumsum(lengths) - lengths
    hot = np.eye(2)[labels]
    inner = np.delete(np.arange(len(labels)), starts)
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (labels[inner - 1], labels[inner]), 1)
    seen = [counted(hot, bins), pairs, hot[starts].sum(0)]
    weights = [np.zeros((BINS, 2)), np.zeros((2, 2)), np.zeros(2)]
    one, two = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1):
        _, share, first, expected = expectations(Field(*weights), bins, lengths)
        for i, e in enumerate((counted(share, bins), expected, first)):
            slope = (seen[i] - e) / len(texts) - PENALTY * weights[i]
            one[i], two[i] = 0.9 * one[i] + 0.1 * slope, 0.999 * two[i] + 0.001 * slope * slope
            weights[i] = weights[i] + RATE * (one[i] / (1 - 0.9**step)) / (np.sqrt(two[i] / (1 - 0.999**step)) + 1e-8)
    return Field(*weights)


def fit(docs: DataFrame, labels: DataFrame) -> Field | None:
    """The field from the labelled rows of docs outside the held-out third."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    short = F.size(F.split(F.coalesce("text", F.lit("")), "\n")) <= SAMPLE_LINES
    training = docs.select("doc_id", "text").filter(bucket("doc_id", 3) != 1).filter(short).join(fitting(stage(known, "labels")), "doc_id")
    # ids first, so that only the texts of the sample are sorted
    sample = training.select("doc_id", "quality", F.xxhash64("text").alias("of")).orderBy(F.xxhash64("doc_id"), "doc_id", "of").limit(SAMPLE)
    chosen = training.join(F.broadcast(stage(sample, "sample").select(F.col("doc_id").alias("d"), F.col("of")).distinct()), (F.col("doc_id") == F.col("d")) & (F.xxhash64("text") == F.col("of")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"quality": batch["quality"], "bins": [read_text(t).bins.tobytes() for t in batch["text"]]})

    rows = chosen.select("quality", "text").distinct().mapInPandas(run, "quality int, bins binary").collect()
    split: tuple[list, list] = ([], [])
    for r in sorted(rows, key=lambda r: (r["quality"], bytes(r["bins"]))):
        split[0 if r["quality"] else 1].append(np.frombuffer(r["bins"], np.uint8).reshape(-1, len(MEASURES)))
    return fit_field(*split)


def judge(field: Field | None):
    """A column function from text to its counts, the characters of words in content lines, and the numbers of these lines."""

    @F.pandas_udf(RESULT)
    def judged(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            x = read_text(text)
            content = np.flatnonzero(np.array(field.labels(x.bins), np.int64) == 0) if field else np.arange(len(x.lines))
            rows.append((x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, int(x.chars[content].sum()), x.lines[content].tolist()))
        return pd.DataFrame(rows, columns=RESULT.names)

    return judged


def rules(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, the counts, base_failed, kept, the content's share of the words' characters, and the numbers of content lines (from 0)."""
    found = docs.select("doc_id", judge(field)(F.col("text")).alias("q")).select("doc_id", "q.*")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    share = F.when(F.col("word_chars") > 0, F.col("content_chars") / F.col("word_chars")).otherwise(0.0)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                        (~failed & (share >= KEPT_SHARE)).alias("kept"), share.alias("content_share"), "content_lines")
