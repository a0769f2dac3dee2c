"""Operators against brute force or planted truths on small data."""

import collections
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratalens.functions.similarity import jaro_winkler, jaro_winkler_pairs, partial_ratio
from stratalens.operators import catalog as K
from stratalens.operators import codes, compare, dependencies, duplicates, grain, lookup, optional, relate, rules
from stratalens.operators.graph import connected_components
from stratalens.operators.profile import count_values, profile, whole_table_profile
from stratalens.operators.similar import similar_pairs
from stratalens.plans.analysis import analyse
from stratalens.sources import loading, readers
from stratalens.sources.sampling import key_sample, plan_key_samples


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 300 + i) for i in range(30)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {n: root(n) for n in list(parent)}


def test_key_check_with_nulls(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "x string")
    summary, examples = grain.key_check(df, ["x"])
    assert tuple(summary.first()) == (5, 2, 2, False) and [tuple(r) for r in examples.collect()] == [("a", 2)]


def smallest_by_hand(rows):
    """All smallest sets of columns that tell the rows apart, by trying all."""
    whole = len(np.unique(rows, axis=0))
    for size in range(1, rows.shape[1] + 1):
        found = [c for c in itertools.combinations(range(rows.shape[1]), size) if len(np.unique(rows[:, c], axis=0)) == whole]
        if found:
            return found
    return []


def test_smallest_sets_are_those_of_all_sets():
    rng = np.random.default_rng(1)
    for _ in range(40):
        columns, n = rng.integers(2, 11), rng.integers(2, 60)
        rows = np.unique(rng.integers(0, rng.integers(2, 5, columns), (n, columns)), axis=0)
        distinct = [len(np.unique(rows[:, c])) for c in range(columns)]
        assert grain.Search(rows, distinct, len(rows)).smallest() == smallest_by_hand(rows)


def test_a_key_of_eleven_among_forty_columns():
    rng = np.random.default_rng(2)
    bits = (np.arange(2048)[:, None] >> np.arange(11)) & 1
    order = rng.permutation(40)
    rows = np.concatenate([bits, rng.integers(0, 2, (2048, 29))], 1)[:, order]
    assert grain.Search(rows, [2] * 40, 2048).smallest() == [tuple(sorted(np.flatnonzero(order < 11).tolist()))]


def test_combinations_hold_on_the_whole_table(spark):
    """A sample of a few rows proposes combinations that the whole table refutes; what is left is what trying all gives."""
    rng = random.Random(4)
    data = [(i % 30, i // 30 % 20, i // 600, rng.randint(0, 400), rng.randint(0, 400), "x" * (i % 3)) for i in range(2400)]
    names = ["a", "b", "c", "d", "e", "f"]
    df = spark.createDataFrame([*data, data[0]], "a int, b int, c int, d int, e int, f string")
    rows = np.array([[*r[:5], len(r[5])] for r in data])
    distinct = {n: len(np.unique(rows[:, i])) for i, n in enumerate(names)}
    expected = [[names[i] for i in c] for c in smallest_by_hand(rows)]
    for sample in (10, 100, 10_000):
        assert grain.smallest_combos(df, distinct, 2400, sample) == expected
    pair = grain.left_together(df, names, ["a", "b"])
    assert pair and all(sum((r["a"], r["b"]) == (x["a"], x["b"]) for x in pair) > 1 for r in pair)


def test_grain(spark):
    rows = [(i // 4, i % 4, i % 7, "c") for i in range(400)]
    df = spark.createDataFrame(rows, "customer_id int, channel int, noise int, fixed string")
    infos = grain.column_infos(profile({"t": df}), "main", "t")
    assert grain.find_grain(df, infos)[0]["combo"] == ["customer_id", "channel"]
    near = df.union(df.limit(0)).union(spark.createDataFrame([(0, 0, 99, "c")], df.schema))
    found = grain.find_grain(near, grain.column_infos(profile({"t": near}), "main", "t"))
    assert found and not found[0]["dup_rows"] or found[0]["near"]


def test_grain_has_no_limit_of_columns_or_results(spark):
    def found(df):
        return [(set(g["combo"]), g["dup_rows"], g["near"]) for g in grain.find_grain(df, grain.column_infos(profile({"t": df}), "main", "t"))]

    # nine columns that come first and tell nothing more, then the two of the key
    wide = spark.range(400).selectExpr(*[f"CAST(id DIV 20 AS int) AS c{k}_id" for k in range(9)], "CAST(id DIV 4 AS int) % 5 AS step", "CAST(id % 4 AS int) AS part")
    assert found(wide) == [({f"c{k}_id", "step", "part"}, 0, False) for k in range(9)]
    four = spark.range(4096).selectExpr(*[f"CAST(id DIV {8 ** k} % 8 AS int) AS k{k}_id" for k in range(4)], "'c' AS fixed")
    assert found(four) == [({"k0_id", "k1_id", "k2_id", "k3_id"}, 0, False)]
    assert found(four.union(four.limit(2))) == [({"k0_id", "k1_id", "k2_id", "k3_id"}, 2, True)]
    assert found(four.union(four)) == []


def test_whole_table_profile_counts_odd_values_of_all_rows(spark):
    df = spark.range(20_000).selectExpr(
        "IF(id % 5 < 2, -1, 1) * (id % 97 + 1D) AS balance", "IF(id % 10 < 3, ' n/a ', concat('t', id % 50)) AS note",
        "IF(id % 4 = 0, DATE'1900-01-01', DATE'2020-05-05') AS day", "IF(id % 8 = 0, 0, id) AS part_id",
        "IF(id % 1000 = 7, 1e9D, id % 31 + 0.5D) AS price", "IF(id % 6 = 0, NULL, concat('u', id % 9, '@x.org')) AS mail")
    got = {r.column_name: r for r in whole_table_profile({"t": df}, sample_rows=1000).collect()}
    whole = {r.column_name: r for r in profile({"t": df}).collect()}
    for name, r in whole.items():
        for field in ("row_count", "non_null", "placeholder_count", "negative_count", "effective_null_pct"):
            assert got[name][field] == r[field], (name, field)
        assert set(got[name].flags) == set(r.flags), name
        if r.outlier_count is not None:
            low, high = got[name].outlier_low, got[name].outlier_high
            assert got[name].outlier_count == df.where(f"{name} < {low} OR {name} > {high}").count()
    assert got["price"].outlier_count == 20 and got["note"].placeholder_count == 6000 and got["balance"].negative_count == 8000
    assert abs(got["mail"].email_rows - got["mail"].non_null) <= 1


def test_dependencies_and_exceptions(spark):
    rows = [(i % 20, f"n{i % 20}" if i % 100 else "typo", i % 4, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "prop_id int, prop_name string, region int, rid int")
    infos = grain.column_infos(profile({"t": df}), "main", "t")
    edges = sorted(map(tuple, dependencies.dependencies(df, infos).collect()))
    for x, y in (("prop_id", "prop_name"), ("region", "prop_id")):
        top, total = {}, {}
        for r in rows:
            a, b = r[["prop_id", "prop_name", "region"].index(x)], r[["prop_id", "prop_name", "region"].index(y)]
            top.setdefault(a, {}).setdefault(b, 0)
            top[a][b] += 1
            total[a] = total.get(a, 0) + 1
        found = dependencies.pair_agreement(df, [(x, [y])]).first()
        assert (found["agreeing"], found["checked"]) == (sum(max(v.values()) for v in top.values()), sum(total.values()))
    by = {(e[0], e[1]): e for e in edges}
    assert by["prop_id", "prop_name"][3] == 20 and by["prop_id", "region"][6] == "exact"
    wrong = dependencies.dependency_exceptions(df, "prop_id", "prop_name").collect()
    assert len(wrong) == 20 and {r["expected_prop_name"] for r in wrong} == {"n0"}


def test_refuted_pairs_leave_and_no_others(spark):
    rng = random.Random(9)
    rows = [(x := rng.randint(0, 300), None if x % 50 == 0 else x // 3, x % 7 if rng.random() < 0.985 else 99, rng.choice([0, 0, 0, 1]), f"n{x // 100}", rng.choice([None, x])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e string, f int")
    names = df.columns
    pairs = [(x, [y for y in names if y != x]) for x in names]
    filled = {n: sum(r[i] is not None for r in rows) for i, n in enumerate(names)}
    whole = {(r["determinant"], r["dependent"]): (r["agreeing"], r["checked"]) for r in dependencies.pair_agreement(df, pairs).collect()}
    for least in (0.98, 0.5, 1.0):
        found = {(x, y): (n, m) for x, y, n, m in dependencies.lasting_pairs(df, pairs, filled, least)}
        assert found == {k: v for k, v in whole.items() if v[0] / v[1] >= least} and 0 < len(found) < len(whole)


def test_optional_groups_with_null_code(spark):
    rows = [("C" if i % 4 == 0 else None if i % 4 == 1 else "I", f"c{i}" if i % 4 == 0 else None, "t" if i % 4 == 0 else "n/a") for i in range(400)]
    df = spark.createDataFrame(rows, "guest_type string, company string, tax string")
    rule = {r["column_name"]: r for r in optional.conditional_fill(optional.fill_by_code(df, ["company", "tax"], ["guest_type"])).collect()}
    assert rule["company"]["when_values"] == ["C"] and rule["tax"]["coverage"] == 1.0 and rule["tax"]["filled_rows"] == 100
    groups = optional.optional_groups(optional.fill_pairs(df, ["company", "tax"])).collect()
    assert groups[0]["columns"] == ["company", "tax"] and groups[0]["similarity"] == 1.0


def test_duplicates_against_all_pairs(spark):
    rng = random.Random(2)
    people = []
    for i in range(60):
        first, last = rng.choice(["anna", "bob", "carla"]), rng.choice(["rossi", "rossie", "bianchi"]) + str(i % 5)
        people.append((i, first, last, f"{first}{i % 9}@x.org" if i % 4 else None, f"19{70 + i % 8}-01-0{1 + i % 5}"))
    df = spark.createDataFrame(people, "id int, first_name string, last_name string, email string, dob string")
    roles = {"first_name": "first_name", "last_name": "last_name", "email": "email", "dob": "dob"}
    records = duplicates.normalised(df, "id", roles)
    got = {(r["ra"], r["rb"]) for r in duplicates.blocking_pairs(records, roles).collect()}
    rows = [r.asDict() for r in records.collect()]
    keys = [lambda r: r["n_email"], lambda r: f"{r['n_first_name']}|{r['n_last_name']}", lambda r: f"{r['n_dob']}|{r['n_last_name'][:3]}"]
    expected = set()
    for key in keys:
        blocks = {}
        for r in rows:
            if key(r):
                blocks.setdefault(key(r), []).append(r["rid"])
        for ids in blocks.values():
            expected |= {(a, b) for a, b in itertools.combinations(sorted(ids), 2)}
    assert got == expected


def scored_by_hand(rows, roles, threshold):
    """Pairs that share a block, with their score, from all pairs."""
    known, out = list(roles), {}
    for x, y in itertools.combinations(sorted(rows), 2):
        a, b = dict(zip(known, x[1:], strict=True)), dict(zip(known, y[1:], strict=True))
        start = {r: f"{v['last_name'][:3]}" if v["last_name"] else None for r, v in (("a", a), ("b", b))}
        share = any(a[r] is not None and a[r] == b[r] for r in ("email", "phone"))
        share |= None not in (a["first_name"], a["last_name"]) and (a["first_name"], a["last_name"]) == (b["first_name"], b["last_name"])
        share |= a["dob"] is not None and a["dob"] == b["dob"] and start["a"] is not None and start["a"] == start["b"]
        both = [r for r in known if a[r] is not None and b[r] is not None]
        if not share or len(both) < duplicates.MIN_COMPARED:
            continue
        similar = sum(duplicates.WEIGHTS[r] * (jaro_winkler(a[r], b[r]) if r in duplicates.NAME_ROLES else float(a[r] == b[r])) for r in both)
        score = similar / sum(duplicates.WEIGHTS[r] for r in both)
        if score >= threshold:
            out[x[0], y[0]] = (round(score, 9), len(both))
    return out


@pytest.mark.parametrize(("threshold", "small", "tile"), [(0.9, 64, 16384), (0.9, 1, 7), (0.8, 3, 20), (0.5, 1, 1000), (0.95, 1, 1)])
def test_similar_pairs_are_all_pairs(spark, threshold, small, tile):
    rng = random.Random(11)
    first = ["anna", "ana", "hannah", "bob", "bobby", "zoë", "x", "carla maria", "a" * 90, "a" * 89 + "b"]
    last = ["rossi", "rosi", "rossie", "bianchi", "biancchi", "de la cruz", "delacruz", "li", "ossir"]
    maybe = lambda v, p=0.8: v if rng.random() < p else None
    rows = [(i, maybe(f"m{rng.randint(0, 25)}@x", 0.5), maybe(str(rng.randint(0, 4))), maybe(rng.choice(first)), maybe(rng.choice(last), 0.9), maybe(f"1990-01-0{rng.randint(1, 6)}", 0.6))
            for i in range(220)]
    roles = ["email", "phone", "first_name", "last_name", "dob"]
    records = spark.createDataFrame([*rows, (None, "m1@x", "1", "anna", "rossi", None)], "rid int, " + ", ".join(f"n_{r} string" for r in roles))
    names = {r: r for r in roles}
    weights = {r: duplicates.WEIGHTS[r] for r in roles}
    found = similar_pairs(records, duplicates.block_keys(names), weights, duplicates.NAME_ROLES, threshold, duplicates.MIN_COMPARED, small, tile).collect()
    expected = scored_by_hand(rows, roles, threshold)
    assert {(r["ra"], r["rb"]): (round(r["score"], 9), r["compared"]) for r in found} == expected and len(found) == len(expected) > 20


def test_jaro_winkler_of_many_pairs():
    rng = random.Random(3)
    a = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [None, "x", "a" * 70, "\x00\x01"]
    b = [rng.choice([x, x[::-1], x[1:] + "x", "".join(rng.sample(x, len(x))), "abc" * 30]) for x in a[:3000]] + ["x", None, "a" * 69, "\x00"]
    expected = [None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)]
    assert [None if v != v else v for v in jaro_winkler_pairs(pd.Series(a), pd.Series(b))] == expected


def test_one_phone_and_many_names(spark):
    """A block with all records: pairs are formed for those that can be similar, and near copies are found."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(6, 10)))
    people = [(i, word(), word(), "+1 555 000 1234") for i in range(6000)]
    people += [(10_000 + i, people[i][1], people[i][2] + "x", "+1 555 000 1234") for i in range(30)]
    df = spark.createDataFrame(people, "id int, first_name string, last_name string, phone string")
    found = duplicates.find_duplicates(df, "id", {"phone": "phone", "first_name": "first_name", "last_name": "last_name"})
    pairs = {(r["ra"], r["rb"]) for r in found["pairs"].collect()}
    assert pairs >= {(i, 10_000 + i) for i in range(30)} and len(pairs) < 60


def test_duplicates_in_large_blocks(spark):
    same = [(i, "ann lee", "a@x.org") for i in range(700)]
    near = [(1000 + i, f"ann lee{'e' * (i % 3)}", "b@x.org") for i in range(600)]
    df = spark.createDataFrame(same + near, "id int, full_name string, email string")
    found = duplicates.find_duplicates(df, "id", {"name": "full_name", "email": "email"})
    summary = found["summary"].first()
    assert (summary["groups"], summary["rows_in_groups"], summary["largest_group"]) == (2, 1300, 700)
    assert summary["pairs"] == 700 * 699 // 2 + 600 * 599 // 2
    assert found["members"].where("rid <> rep").count() == 1300 - 4 and found["pairs"].count() == 3


def test_name_folding(spark):
    df = spark.createDataFrame([("Zoë",), ("  ÉLODIE ",), ("n/a",), ("",)], "v string")
    assert [r[0] for r in df.select(duplicates.normalise_role("first_name", "v")).collect()] == ["zoe", "elodie", None, None]


def test_similar_and_suggested_codes(spark):
    a = spark.createDataFrame([("CONF", 5), ("Cxl ", 3), ("NEW STATE", 1)], "value string, n int")
    b = spark.createDataFrame([("CONF", 9), ("CXL", 2), ("NEW STATES", 1)], "value string, n int")
    got = {(r["left_value"], r["right_value"]): (r["status"], r["suggestion"]) for r in codes.suggest_matches(codes.compare_code_lists(a, b)).collect()}
    assert got["CONF", "CONF"][0] == "same" and got["Cxl ", "CXL"][0] == "case/space"
    assert got["NEW STATE", None] == ("only left", "NEW STATES") and got[None, "NEW STATES"] == ("only right", "NEW STATE")


def test_compare_dates_in_two_formats(spark):
    left = spark.createDataFrame([("k1", "01/02/1980", "ROSSI"), ("k2", "1990-03-04", "X"), ("k3", None, "Verdi")], "k string, BirthDate string, FamilyName string")
    right = spark.createDataFrame([("k1", "1980-02-01", "Rossi"), ("k2", "1990-03-05", None)], "code string, date_of_birth string, last_name string")
    got = {r["left_column"]: r for r in compare.compare_attributes(left, "k", right, "code", [("BirthDate", "date_of_birth"), ("FamilyName", "last_name")],
                                                                   {"BirthDate"}, {"date_of_birth"}).collect()}
    assert (got["BirthDate"]["equal_normalised"], got["BirthDate"]["differ"], got["BirthDate"]["equal_raw"]) == (1, 1, 0)
    assert got["FamilyName"]["only_left"] == 1 and got["FamilyName"]["agree_pct"] == 100.0


def test_discovery_and_keyed_samples(spark):
    parent = spark.createDataFrame([(i, f"g{i}") for i in range(2000)], "guest_id int, guest_code string")
    child = spark.createDataFrame([(i, i * 7 % 2000 if i % 17 else None, 1.0 * i) for i in range(5000)], "stay_id int, guest_id int, amount double")
    named = {"pms.guest": parent, "pms.stay": child}
    counted = count_values(named)
    links = relate.discover_relationships(counted.freq, profile(named, counted=counted)).collect()
    link = {(r["from_table"], r["from_column"], r["to_table"]): r for r in links}["stay", "guest_id", "guest"]
    assert link["cardinality"] == "1:N" and link["fk_null_pct"] > 5 and "(optional)" in link["summary"] and link["orphan_rows"] == 0
    assert not any(r["from_column"] == "amount" for r in links)
    plan = plan_key_samples([link.asDict()], {"pms.guest": 2000, "pms.stay": 5000}, {"pms.guest": 500, "pms.stay": 500})
    a, b = (key_sample(df, plan[t]["column"], plan[t]["ppm"]) for t, df in (("pms.stay", child), ("pms.guest", parent)))
    assert 0 < a.count() < 1500 and relate.orphan_rows(a, "guest_id", b, "guest_id").count() == 0


def test_predicates(spark):
    df = spark.createDataFrame([(" Ab ", 1.5, "2024-03-05 10:00:00"), ("50%_x", 2.0, "2024-04-01 00:00:00"), (None, None, None)], "s string, d double, t string")
    df = df.withColumn("t", F.col("t").cast("timestamp"))
    n = lambda c, op, *v: df.where(lookup.filter_predicate(df, c, op, list(v))).count()
    assert (n("s", "=", "AB"), n("s", "~", "%_"), n("s", "!=", "ab"), n("d", "=", "2"), n("d", "!=", "2"), n("d", "=", "x")) == (1, 1, 1, 1, 1, 0)
    assert (n("t", "=", "2024-03"), n("t", "=", "2024-03-05"), n("t", "=", "2024-03-05 1"), n("t", ">", "2024-03-31"), n("t", "!=", "2024-04")) == (1, 1, 1, 1, 1)


def test_sample_is_repeatable_and_filtered(spark):
    df = spark.range(50000).withColumn("rare", (F.col("id") % 100 == 0))
    rows, matched = lookup.sample_rows(df, 20, where="rare", seed=5)
    again, _ = lookup.sample_rows(df, 20, where="rare", seed=5)
    assert matched.first()[0] == 500 and rows.count() == 20 and {r["id"] for r in rows.collect()} == {r["id"] for r in again.collect()}
    assert all(r["rare"] for r in rows.collect())


def test_discover_part_files():
    part = loading.one_table_in_parts
    assert part(["part-00000-abc.snappy.parquet", "part-00001-abc.snappy.parquet"]) and part(["year=2026/a.parquet", "year=2027/b.parquet"])
    assert part(["reservation_001.csv", "reservation_002.csv"]) and not part(["customer.csv", "orders.csv"])
    assert loading.safe_table_name("2024 Sales-Data") == "t_2024_sales_data" and readers.format_of("x.csv.gz") == "csv"


def test_load_keeps_going(spark, tmp_path):
    (tmp_path / "good.csv").write_text("id,name\n1,a\n2,b\n")
    (tmp_path / "good.json").write_text('[{"id": 1}, {"id": 2}, {"id": 3}]')
    (tmp_path / "bad.parquet").write_text("not parquet")
    found = loading.discover_tables(spark, str(tmp_path))
    assert sorted(f.table for f in found) == ["bad", "good", "good_2"]
    tables, log = loading.load_tables(spark, found, "s", str(tmp_path / "out"))
    rows = {r["table_name"]: r for r in log.collect()}
    assert rows["good"]["row_count"] == 2 and rows["good_2"]["row_count"] == 3 and rows["bad"]["error"] and len(tables) == 2


def test_fuzzy_search_scores(spark):
    one = spark.createDataFrame([("reservation_id", "amount", "Date of birth of the guest", "guestbirthdate", None, "see reservaton, or not")], "a string, b string, c string, d string, e string, f string")

    def score(kind, term, name):
        return one.select(kind(term, F.col(name))).first()[0]

    assert score(K.fuzzy_name, "reservationid", "a") == 100 and score(K.fuzzy_name, "reservation", "a") == 95 and score(K.fuzzy_name, "reservaton", "a") >= 72
    assert score(K.fuzzy_name, "guest", "b") < 72 and score(K.fuzzy_name, "date birth", "d") == 86 and score(K.fuzzy_name, "date", "e") == 0 and score(K.fuzzy_name, "-", "a") == 0
    # spellings: the ratio of 13 and 14 letters with 12 in common, and a part of the name
    assert score(K.fuzzy_name, "resrvationid", "a") == round(0.9 * 200 * 12 / 25, 1) and score(K.fuzzy_name, "servaton", "a") == round(0.9 * max(200 * 8 / 21, 0.88 * partial_ratio("servaton", "reservationid")), 1)
    assert score(K.fuzzy_text, "birth date", "c") == 82 and score(K.fuzzy_text, "birth of", "c") == 85 and score(K.fuzzy_text, "of", "c") == 0
    assert score(K.fuzzy_text, "reservation", "f") == 0.9 * round(0.9 * 200 * 10 / 21, 1) and score(K.fuzzy_text, "guest", "e") == 0


def test_pair_counts_against_all_pairs(spark):
    rng = random.Random(6)
    columns = {i: [rng.randint(0, 12 + 3 * i) for _ in range(rng.choice([0, 1, 30, 60]))] for i in range(7)}
    freq = [(i, str(v), n) for i, vs in columns.items() for v, n in collections.Counter(vs).items()]
    pairs = [(a, b) for a in columns for b in columns if a != b and rng.random() < 0.6]
    found = relate.pair_counts(spark.createDataFrame(freq, "col_id int, value string, n long"), spark.createDataFrame([*pairs, pairs[0]], "from_id int, to_id int"))
    expected = {}
    for a, b in pairs:
        x, y = collections.Counter(columns[a]), collections.Counter(columns[b])
        both = [x[v] for v in x if v in y]
        if x or y:
            expected[a, b] = (len(x), x.total(), len(y), max(y.values(), default=None), len(both), sum(both), max(both, default=None))
    assert {(r["from_id"], r["to_id"]): tuple(r[c] for c in ("child_values", "child_rows", "parent_values", "parent_most", "matched", "matched_rows", "matched_most"))
            for r in found.collect()} == expected


def test_analysis_suggests_rules_that_hold(spark, sf):
    named = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("nation", "region", "customer")}
    result = analyse(named)
    assert not result.errors and result.relationships.count() == 2
    kinds = {r["rule"] for r in result.rules.collect()}
    assert {"unique", "foreign_key", "in_list", "not_empty", "not_null"} <= kinds
    checked = rules.evaluate_rules(named, result.rules.where("criticality = 'error'")).collect()
    assert checked and all(r["failing_rows"] == 0 for r in checked)
