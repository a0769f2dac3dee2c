"""What grows with the input: plans and results that must hold on larger tables."""

import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql.readwriter import DataFrameWriter

from stratalens.functions import similarity
from stratalens.functions.similarity import jaro_winkler, partial_ratio, ratio
from stratalens.operators import catalog as K
from stratalens.operators import compare, duplicates, grain, near_names, relate, similar
from stratalens.operators.profile import count_values, profile
from stratalens.operators.value_freq import value_freq
from stratalens.staging import SPLIT_BYTES, _bytes, small_tasks


def snapshot(spark, rows):
    names = "table_name string, column_name string, data_type string, comment string, table_comment string, dropped boolean"
    return spark.createDataFrame(rows, names)


def test_schema_diff_broadcasts_table_names_only(spark, tmp_path):
    rows = [(f"t{i % 3}", f"c{i}", "int", "x", "y", False) for i in range(300)]
    for name, part in (("old", rows[:-5]), ("new", [(t, c, "string" if c == "c7" else d, *rest) for t, c, d, *rest in rows[2:]])):
        snapshot(spark, part).write.parquet(str(tmp_path / name))
    found = K.schema_diff(spark.read.parquet(str(tmp_path / "old")), spark.read.parquet(str(tmp_path / "new")))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    # a snapshot can have millions of columns however small its file is: it must never be the side that is sent to the driver
    assert "BuildLeft" not in plan and plan.count("SortMergeJoin") == 1
    got = sorted((r["change"], r["column_name"]) for r in found.collect())
    assert got == [("column_added", f"c{i}") for i in range(295, 300)] + [("column_dropped", "c0"), ("column_dropped", "c1"), ("type_changed", "c7")]


def test_blocking_pairs_are_not_gathered_to_find_repeated_ones(spark):
    people = [(i, f"m{i // 3}" if i % 4 else None, f"p{i % 7}", f"f{i % 5}", f"name{i % 6}", f"d{i % 2}") for i in range(60)]
    roles = {r: r for r in ("email", "phone", "first_name", "last_name", "dob")}
    records = spark.createDataFrame(people, "rid int, n_email string, n_phone string, n_first_name string, n_last_name string, n_dob string")
    pairs = duplicates.blocking_pairs(records, roles)
    assert "keys=[ra#" not in pairs._jdf.queryExecution().sparkPlan().toString()

    def keys(p):
        return {(k, v) for k, v in enumerate((p[1], p[2], p[3] + p[4], p[5] + p[4][:3])) if v is not None}

    got = [(r["ra"], r["rb"]) for r in pairs.collect()]
    assert sorted(got) == [(a[0], b[0]) for a, b in itertools.combinations(people, 2) if keys(a) & keys(b)]


def test_blocking_pairs_of_large_blocks_in_tiles_and_few_bytes(spark, monkeypatch, tmp_path):
    rng = random.Random(4)
    people = [(f"r{i:04}", rng.choice([None, f"m{i % 300}"]), rng.choice([None, "p1", "p1", "p2"]), f"f{i % 9}", rng.choice(["ross", "rossi", None]), "d1") for i in range(500)]
    schema = "rid string, n_email string, n_phone string, n_first_name string, n_last_name string, n_dob string"
    roles = {r: r for r in ("email", "phone", "first_name", "last_name", "dob")}
    whole = [{(k, v) for k, v in enumerate((p[1], p[2], p[4] and p[3] + p[4], p[4] and p[5] + p[4][:3])) if v is not None} for p in people]
    want = [(people[x][0], people[y][0]) for x, y in itertools.combinations(range(500), 2) if whole[x] & whole[y]]
    monkeypatch.setattr(duplicates, "BLOCK_ROWS", 64)
    monkeypatch.setattr(duplicates, "CHUNK", 8)
    records = spark.createDataFrame(rng.sample(people, 500), schema)
    assert sorted(map(tuple, duplicates.blocking_pairs(records, roles).collect())) == want
    monkeypatch.undo()
    # one block of 1,999,000 pairs: what is written follows from its records, not from two numbers a pair
    one = spark.range(2000).selectExpr("id * 977 % 2000 AS rid", "'p' AS n_phone", "concat('n', id) AS n_name")
    duplicates.blocking_pairs(one, {"phone": "phone", "name": "name"}).write.parquet(str(tmp_path / "out"))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == found.distinct().count() == 1999 * 1000 and found.where("ra >= rb").isEmpty()
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 1999 * 1000 // 2


def test_grain_keeps_a_given_order_of_columns():
    info = lambda name, d: {"column_name": name, "distinct_count": d, "non_null": 90, "row_count": 90, "family": "string", "data_type": "string", "avg_len": 3}
    infos = [info("a_key", 10), info("b_key", 90), info("c", 50)]
    names = lambda order: [i["column_name"] for i in grain.grain_candidates(infos, order)]
    assert names(None) == ["b_key", "a_key", "c"] and names(["a_key", "b_key"]) == ["a_key", "b_key", "c"]


def test_combinations_are_counted_once_and_refuted_from_few_groups(spark):
    # a alone is refuted by one group only; full copies speak against nothing
    df = spark.createDataFrame([(i, i % 7, i % 3) for i in range(200)] * 2 + [(5, 6, 0)], "a int, b int, c int")
    d, marks = grain.count_combo(df, ["a"], 400)
    assert d == 200 and len(marks) > 50
    assert sorted(tuple(r) for r in grain.left_together(df, ["a", "b", "c"], ["a"], marks)) == [(5, 5, 2), (5, 6, 0)]
    assert sorted(tuple(r) for r in grain.left_together(df, ["a", "b", "c"], ["a"], marks[:1])) == [(5, 5, 2), (5, 6, 0)]
    assert grain.left_together(df, ["a", "b", "c"], ["a", "b", "c"], marks) == []


def test_counts_are_written_without_a_sort_by_family(spark, monkeypatch):
    df = spark.createDataFrame([(1, "x", 0.5), (2, "x", None), (2, None, 1.5)], "k int, t string, v double")
    want = sorted(map(str, value_freq({"s": df}).collect()))
    monkeypatch.setattr(DataFrameWriter, "partitionBy", lambda *a: 1 / 0)
    assert sorted(map(str, count_values({"s": df}).counts.select(*value_freq({"s": df}).columns).collect())) == want


def test_both_zeros_are_counted_apart_by_text(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (-0.0,), (1.5,), (None,)], "x double")
    got = lambda **how: sorted((r["value"] or "", r["n"]) for r in value_freq({"t": df}, **how).collect())
    assert got(by_text=True) == [("", 1), ("-0.0", 2), ("0.0", 1), ("1.5", 1)]
    assert len(got()) == 3


def test_suggested_names_are_the_best_of_all_but_few_are_scored(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "_".join(rng.choice(["hot", "rod", "small", "Bolt", "é", "x1"]) for _ in range(rng.randint(1, 3))) + str(rng.randint(1, 99))
    lost, there = sorted({word() for _ in range(25)}), sorted({word().upper() for _ in range(120)} | {"__"})
    notes = spark.createDataFrame([("s", "t", n) for n in lost], "schema_name string, table_name string, column_name string")
    catalog = spark.createDataFrame([("s", "t", n) for n in there], notes.schema)
    clean = lambda n: re.sub("[^a-z0-9]", "", n.lower())
    want = []
    for a in lost:
        scores = [(round(max(ratio(clean(a), clean(b)), partial_ratio(clean(a), clean(b)) - 5), 1), b) for b in there]
        want += [(a, b, s, i) for i, (s, b) in enumerate(sorted((x for x in scores if x[0] >= 60), key=lambda x: (-x[0], x[1]))[:3], 1)]
    monkeypatch.setattr(K, "REMAP_TILE", 40)
    got = K.suggest_remaps(notes, notes, catalog).select("column_name", "candidate", "score", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    frame = pd.DataFrame({"column_name": ["a"], "form": ["smallbolt17"]}), pd.DataFrame({"candidate": there, "form": [clean(n) for n in there]})
    assert len(K._nearest_names(("s", "t"), *frame, 3)) < len(there) / 2


def test_names_of_a_huge_block_are_found_by_their_marks(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    first, last = [word() for _ in range(40)], [word() + rng.choice(["", "son", "x"]) for _ in range(60)]
    swap = lambda w: w[1:2] + w[:1] + w[2:] if rng.random() < 0.3 else w[:-1] if rng.random() < 0.2 else w
    people = [(i, rng.choice(["p", "p", "p", None]), rng.choice([None, *[swap(x) for x in first]]), rng.choice([None, "y" * 70, *[swap(x) for x in last]]),
               rng.choice([None, None, f"m{i % 9}"])) for i in range(700)]
    records = spark.createDataFrame(people, "rid int, n_phone string, n_first_name string, n_last_name string, n_email string")
    for roles, threshold in ((("phone", "first_name", "last_name"), 0.9), (("email", "phone", "first_name", "last_name"), 0.95)):
        weights, named = {r: duplicates.WEIGHTS[r] for r in roles}, {r: r for r in roles}
        find = lambda **how: sorted(map(tuple, similar.similar_pairs(
            records, duplicates.block_keys(named), weights, duplicates.NAME_ROLES, threshold, duplicates.MIN_COMPARED, **how).collect()))
        # one join of all pairs against marks; with small tiles marks that many share are dealt out
        want = find(small=10_000)
        assert len(want) > 40 and find(small=16, tile=100, indexed=100) == want


def test_equal_names_meet_by_one_mark(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    people = [(2 * i + k, first + "e" * k, last, "p") for i in range(60) for first, last in [(word(7), word(9))] for k in (0, 1)]
    records = spark.createDataFrame(people, "rid long, n_first_name string, n_last_name string, n_phone string")
    roles = {r: duplicates.WEIGHTS[r] for r in ("phone", "first_name", "last_name")}
    monkeypatch.setattr(near_names, "BATCH", 50)
    monkeypatch.setattr(type(records), "dropDuplicates", lambda df, *a: df)
    rows = records.selectExpr("*", "0 AS block", "'p' AS value")
    # as tasks find them: a pair with an equal name once, not once for each of the marks that it shares
    found = [(r["ra"], r["rb"]) for r in near_names.indexed_pairs(rows, [], roles, duplicates.NAME_ROLES, 0.9, 2, 0.82, 1000, "long").collect()]
    assert sorted(found) == [(2 * i, 2 * i + 1) for i in range(60)]


def test_least_common_characters_hold_for_all_starts():
    rng = random.Random(2)
    for _ in range(4000):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(2))
        score = jaro_winkler(a, b)
        wanted = set(near_names.labels(0.8, len(a), len(b)))
        chars = [similarity.code_points([x], len(x))[0].T for x in (a, b)]
        seed = np.zeros(1, np.uint64)
        shared = any(set(near_names.marks(chars[0], seed, *label).ravel().tolist()) & set(near_names.marks(chars[1], seed, *label).ravel().tolist()) for label in wanted)
        assert shared or score < 0.8


def test_linked_values_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch):
    left = spark.createDataFrame([(i // 2, f"A{i % 3}" if i % 5 else None, f"b{i}") for i in range(200)], "k int, x string, y string")
    right = spark.createDataFrame([(i, f"a{i % 3}", None) for i in range(100)], "k int, u string, v string")
    monkeypatch.setattr(compare, "TASK_VALUES", 60)
    parts = []
    monkeypatch.setattr(compare, "_equal_values", lambda a, b, n, real=compare._equal_values: parts.append((n, real(a, b, n))) or parts[0][1])
    got = {(r["left_column"], r["right_column"]): (r["both_filled"], r["agree"]) for r in compare.attribute_agreement(left, "k", right, "k").collect()}
    assert got == {("x", "u"): (160, sum(i % 5 > 0 and i % 3 == i // 2 % 3 for i in range(200))), ("y", "u"): (200, 0)}
    # 400 values on the left, 200 on the right; nothing is counted before it is dealt out
    plan = parts[0][1]._jdf.queryExecution().executedPlan().toString()
    assert parts[0][0] == 10 and plan.count(", 10)") == 2


def test_more_values_are_counted_by_more_tasks(spark):
    wide = spark.range(5_000_000, numPartitions=4).selectExpr("xxhash64(id) AS a")
    counted = count_values({"t": wide})
    # the session has 4 shuffle partitions, which held a quarter of all values each however many there were
    assert len(counted.counts.inputFiles()) > 4 and counted.counts.count() == 5_000_000


def test_sizes_of_tasks_are_put_back(spark):
    split, shuffle = "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    parts = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    seen = lambda: [spark.conf.get(split), spark.conf.get(shuffle), spark.conf.get(parts, None)]
    before = seen()

    @small_tasks
    def inner(df, fail=False):
        if fail:
            raise ValueError("inner")
        return seen()

    outer = small_tasks(lambda df: (inner(df), seen()))
    spark.conf.set(shuffle, "2m")                   # smaller than the fixed value: stays
    try:
        within, after_inner = outer(spark.range(1))
        assert within == after_inner == [str(SPLIT_BYTES), "2m", "400"]
        with pytest.raises(ValueError):
            inner(spark.range(1), fail=True)
        assert seen() == [before[0], "2m", before[2]]
    finally:
        spark.conf.unset(shuffle)
    assert [_bytes(x) for x in ("7", "16m", "64MB", "128b", "1g")] == [7, 16 << 20, 64 << 20, 128, 1 << 30]


def test_links_are_found_by_small_tasks(spark, monkeypatch):
    sizes, write = [], relate.stage
    monkeypatch.setattr(relate, "stage", lambda df, label: (sizes.append(spark.conf.get("spark.sql.files.maxPartitionBytes")), write(df, label))[1])
    named = {"site": spark.range(2, 40).toDF("site_id"), "visit": spark.range(2, 400).selectExpr("id AS visit_id", "2 + id % 30 AS site_id")}
    links = relate.find_links(named)
    assert len(sizes) == 5 and set(sizes) == {str(SPLIT_BYTES)}
    counted = count_values(named)
    relate.discover_relationships(counted.freq, profile(named, counted=counted))
    assert len(sizes) == 8 and set(sizes) == {str(SPLIT_BYTES)}
    assert [(r["from_table"], r["to_table"]) for r in links.collect()] == [("visit", "site")]
