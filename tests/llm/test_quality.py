"""Quality rules: counts, decoding, fit and verdicts against brute force, with nulls, empty and long texts, ties, repeats and clashing names."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.llm import quality
from stratalens.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = {"q": 1, "quality": 5, "n_words": 2, "kept": "x", "content_share": 3.0, "bins": 4, "of": 6, "d": 7}


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), dup, len(covered), failed


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["the", "of", "Über", "漢字", "a#b", "$$", "x|y", "and", "end.", "NO!!", "\x85", "\xa0", "12"]
    out = [None, "", " \n\t", "\n\n", "one", "a b c\n", "\x1c\x1f", "😀 \x00 y", "word " * 30_000, "x" * 300_000 + "\n" + "y z\n" * 3]
    for _ in range(200):
        lines = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(rng.randint(1, 12))]
        lines += rng.choices(lines, k=rng.randint(0, 4))
        out.append(rng.choice(["\n", "\r\n", "\n \n"]).join(lines))
    return out


def test_counts(texts):
    for text in texts:
        x = quality.read_text(text)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == counts(text)[:5]
        lines = [(i, sum(map(len, WORD.findall(line)))) for i, line in enumerate((text or "").split("\n")) if WORD.search(line)]
        assert list(zip(x.lines.tolist(), x.chars.tolist(), strict=True)) == lines and x.bins.shape == (len(lines), len(quality.MEASURES))


def field(rng):
    return quality.Field(rng.normal(size=(quality.BINS, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))


def lines_of(rng, n):
    return np.stack([rng.integers(0, len(ends) + 1, n) for ends in quality.MEASURES.values()], 1).astype(np.uint8)


def every(f, bins):
    """The score of each sequence of labels."""
    own = f.scores(bins)
    return {y: f.first[y[0]] + sum(own[i, y[i]] for i in range(len(y))) + sum(f.after[a, b] for a, b in itertools.pairwise(y)) for y in itertools.product((0, 1), repeat=len(bins))}


def test_viterbi_and_expectations():
    rng = np.random.default_rng(0)
    for _ in range(30):
        f, lengths = field(rng), np.sort(rng.integers(1, 7, 5))[::-1]
        parts = [lines_of(rng, n) for n in lengths]
        logs, share, first, pairs = quality.expectations(f, np.concatenate(parts), lengths)
        want, want_first, want_pairs, want_share = 0.0, np.zeros(2), np.zeros((2, 2)), []
        for bins in parts:
            scores = every(f, bins)
            assert tuple(f.labels(bins)) == max(scores, key=scores.get)
            total = np.logaddexp.reduce(list(scores.values()))
            want += total
            own = np.zeros((len(bins), 2))
            for y, s in scores.items():
                p = np.exp(s - total)
                want_first[y[0]] += p
                for i, label in enumerate(y):
                    own[i, label] += p
                for a, b in itertools.pairwise(y):
                    want_pairs[a, b] += p
            want_share.append(own)
        assert np.allclose(logs, want) and np.allclose(share, np.concatenate(want_share)) and np.allclose(first, want_first) and np.allclose(pairs, want_pairs)


def test_a_tie_is_content():
    flat = quality.Field(np.zeros((quality.BINS, 2)), np.zeros((2, 2)), np.zeros(2))
    assert flat.labels(lines_of(np.random.default_rng(1), 4)) == [0, 0, 0, 0] and flat.labels(np.zeros((0, 12), np.uint8)) == []


GOOD, JUNK = "Here is a line of common words that ends well.", "Home | About | News | Contact | Login | Help"


@pytest.fixture(scope="module")
def table(spark):
    rng, rows = random.Random(8), []
    for i in range(240):
        good, junk = ([" ".join(rng.sample(x.split(), len(x.split()))) for _ in range(rng.randint(4, 9))] for x in (GOOD, JUNK))
        text = "\n".join(good if i % 3 else junk + good[:1])
        rows.append((i, text, 1 if i % 3 else 0))
    extra = [(1000, None, None), (1001, "", None), (1002, "\n".join([JUNK] + [" ".join(rng.sample(GOOD.split(), 10)) for _ in range(9)]), None), (3, rows[3][1], None), (None, rows[1][1], None)]
    docs = spark.createDataFrame([r[:2] for r in rows + extra], "doc_id long, text string").withColumns({k: F.lit(v) for k, v in CLASHING.items()})
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(4, 1, 0), (None, 1, 0), (5000, 0, 1), (7, None, 0)], "doc_id long, quality int, toxic int")
    return rows + extra, docs, labels


def test_rules(table):
    rows, docs, labels = table
    f = quality.fit(docs, labels)
    found = quality.rules(docs, f).collect()
    assert len(found) == len(rows)
    by_text = {}
    for r in found:
        if r.doc_id is not None and r.doc_id < 240:
            by_text[r.doc_id] = r
    held_out = [(i, y) for i, _, y in rows[:240] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held_out) > 20 and [i for i, y in held_out if by_text[i].kept != bool(y)] == []
    for (i, text, _), r in ((x, by_text.get(x[0])) for x in rows[:240]):
        assert tuple(r)[1:7] == counts(text) and 0 <= r.content_share <= 1, i
    mixed = next(r for r in found if r.doc_id == 1002)
    assert mixed.kept and 0 not in mixed.content_lines and len(mixed.content_lines) == 9
    assert [(r.n_words, r.base_failed, r.kept, r.content_share) for r in found if r.doc_id in (1000, 1001)] == [(0, True, False, 0.0)] * 2


def test_without_labels_or_rows(table):
    _, docs, labels = table
    assert quality.fit(docs, labels.limit(0)) is None and quality.fit(docs, labels.filter("quality = 1")) is None and quality.fit(docs.limit(0), labels) is None
    found = quality.rules(docs, None).collect()
    assert all(r.kept != r.base_failed for r in found) and quality.rules(docs.limit(0), None).count() == 0


def test_the_fit_does_not_depend_on_the_order_of_rows(table):
    _, docs, labels = table
    a, b = quality.fit(docs, labels), quality.fit(docs.repartition(5, "text"), labels.repartition(3))
    assert np.allclose(a.bins, b.bins) and np.allclose(a.after, b.after)


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = QUERIES["op11_quality_rules"](spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in found} == {i: counts(t) for i, t in docs.items()}
    assert not any(r.kept and r.base_failed for r in found)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(r.kept, labels[r.doc_id]) for r in found if r.doc_id in labels and not r.base_failed and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(k == bool(y) for k, y in judged) >= 0.9 * len(judged)
