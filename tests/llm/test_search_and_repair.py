"""Ranked lexical search and conversation repair against brute force, with nulls, empty and long texts, ties, repeats and clashing names."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.llm import lexical, repair
from stratalens.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = {"n": 1, "terms": "x", "counts": 2, "score": 3, "rank": 4, "query": 5, "salt": 6, "block": 7, "copy": 8, "conv": "c", "digest": "d", "code": 9, "kind": 1}


def with_clashing(df):
    return df.withColumns({k: F.lit(v) for k, v in CLASHING.items() if k not in df.columns})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def searched(docs, items, k=10):
    held = [(i, collections.Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(held), sum(c.total() for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, counts in held:
            m = 25 + (75 * counts.total() * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m)) for t in terms(text) if counts[t])
            if score:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if none else doc_id, -s) for rank, (s, none, doc_id) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdé9") for _ in range(rng.randint(1, 5))) for _ in range(150)]
    texts = [" ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(150)], k=rng.randint(1, 60))) for _ in range(400)]
    texts += [None, "", " .,;", "x" * 100_000, " ".join(vocabulary * 300), texts[7].upper(), "ÀÉ àé ÀÉ", "a_b a-b A.B"]
    docs = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(3, texts[0])] * 3 + [(None, texts[1]), (None, texts[1])] + [(2000 + i, texts[2]) for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(30)] + [(99, None), (98, ""), (97, "zzzz notthere"), (5, texts[1]), (None, texts[2])]
    return docs, items + [(96, texts[2] + " " + texts[2])]


@pytest.mark.parametrize("shard", [40, 3000, 10**6])
def test_search(spark, corpus, monkeypatch, shard):
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "BLOCK_CHARS", 600)
    docs, items = corpus
    rows = with_clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    found = lexical.ranked(rows, with_clashing(spark.createDataFrame(items, "item_id long, text string")))
    assert sorted((tuple(r) for r in found.collect()), key=str) == searched(docs, items)


def test_search_of_nothing(spark, corpus):
    docs, items = (spark.createDataFrame(rows, f"{name} long, text string") for rows, name in zip(corpus, ("doc_id", "item_id"), strict=True))
    assert lexical.ranked(docs.limit(0), items).count() == 0 and lexical.ranked(docs, items.limit(0)).count() == 0


def test_range_maxima():
    rng = np.random.default_rng(1)
    term, doc = np.sort(rng.integers(0, 5, 300)), rng.integers(0, 50, 300)
    term, doc = np.unique(np.stack([term, doc]), axis=1)
    shard = lexical.Shard(np.arange(50), term, doc, rng.integers(0, 9, len(term)), 5)
    for t in range(5):
        for low, high in itertools.combinations(range(shard.starts[t], shard.starts[t + 1] + 1), 2):
            assert shard.added[shard.largest(np.array([low]), np.array([high]))[0]] == shard.added[low:high].max()


SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def edited(rows, length):
    """The cheapest and least of all lists of edits up to a length: cost, audit and repaired rows."""
    best = (math.inf, "", [])

    def go(i, cost, audit, said):
        nonlocal best
        if cost > best[0] or len(audit) > length:
            return
        roles = "".join(r[:1] or "?" for r, _ in said)
        if not re.fullmatch("s?(ua)*u?", roles):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best, (cost, audit, said))
        for role in ("user", "assistant"):
            go(i, cost + 5, audit + "I", [*said, (role, "")])
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, cost + 2, audit + "D", said)
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                go(i + 1, cost + more, audit + "K", [*said, (role, text)])
                for other in ("user", "assistant"):
                    go(i + 1, cost + more + 1, audit + "R", [*said, (other, text)])

    go(0, 0, "", [])
    return best


def repaired(rows):
    """What a conversation's rows give, by all lists of edits."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, told = set(), []
    for _, _, role, text in rows:
        core = text.strip(SPACE)
        told.append((role, text, "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None))
        seen.add((role, text))
    cost, audit, said = edited(told, len(rows) + 3)
    turns = [t for _, t, _, _ in rows if t is not None]
    faults = [sum(f == x for _, _, f in told) for x in ("blank", "duplicate", "truncated")]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
    return max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults, illegal, cost, audit, digest


@pytest.fixture(scope="module")
def turns():
    rng, rows = random.Random(2), []
    texts = ["hello.", "what now?", "cut off", "", " \t", None, "same.", "same.", "long " * 20_000 + "end!", "é 漢字.\x00", "a\xa0"]
    for conv in range(150):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User", "usher"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn // 2, turn * 3]), role, rng.choice(texts)))
    rows += [(200, i, ["user", "assistant"][i % 2], f"turn {i}.") for i in range(5)]
    return rows + rows[-2:] * 2 + [(None, 1, "user", "hi."), (None, None, None, None), (-5, 9_007_199_254_740_993, "user", "x."), (-5, 9_007_199_254_740_995, "assistant", "x.")]


def expected(rows, convs):
    by_conv = collections.defaultdict(list)
    for r in rows:
        by_conv[r[0]].append(r)
    return {c: repaired(by_conv[c]) for c in convs}


@pytest.mark.parametrize(("block", "fan_in"), [(10_000, 1000), (2, 2), (1, 3)])
def test_repair(spark, turns, block, fan_in):
    df = with_clashing(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).repartition(4)
    found = repair.repaired(repair.damaged(df), df, block, fan_in).collect()
    want = expected(damaged(turns), {r[0] for r in turns})
    found_by = {r.conv_id: tuple(r)[1:] for r in found}
    assert [(c, found_by.get(c), want[c]) for c in want if found_by.get(c) != want[c]] == []
    assert len(found) == len(want)
    # an insertion is never cheapest at these costs, it is always among the lists that are compared
    assert set("".join(v[6] for v in want.values())) == {"D", "K", "R"}


def test_repair_of_undamaged_rows_and_of_nothing(spark, turns):
    rows = [(c, t, r or " ", x or " ") for c, t, r, x in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r.conv_id: tuple(r)[1:] for r in repair.repaired(df).collect()} == expected(rows, {r[0] for r in rows})
    assert repair.repaired(df.limit(0)).count() == 0
    only = repair.repaired(df.limit(0), df.filter("conv_id = 1")).collect()
    assert [tuple(r) for r in only] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_repair_of_a_conversation_with_a_third_of_all_rows(spark):
    """One conversation over many blocks, whose path is that of dynamic programming row by row."""
    rng = random.Random(4)
    rows = [(1, i, rng.choice(["user", "assistant", "assistant", "x"]), rng.choice([f"t {i}.", f"cut {i}", "again.", ""])) for i in range(1500)]
    rows += [(2 + i // 5, i % 5, ["user", "assistant"][i % 2], f"t {i}.") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    small, large = ({r.conv_id: tuple(r) for r in repair.repaired(df, None, *sizes).collect()} for sizes in ((7, 5), (10_000, 1000)))
    assert small == large and len(small[1][7]) >= 1500 and len(small) == 601


def test_queries(spark, sf):
    items = {r.item_id for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    found = QUERIES["op13_ranked_search"](spark, sf).collect()
    assert {r.item_id for r in found} == items and max(r["rank"] for r in found) == 10
    convs = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, sf).collect()} == expected(damaged(convs), {r[0] for r in convs})
