"""Single-value functions against plain Python on small fixtures."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from stratalens.functions import similarity as S
from stratalens.functions import values as V
from stratalens.operators import profile as P
from stratalens.operators.privacy import mask_text, mask_value, pii_reason
from stratalens.operators.quantiles import quantiles
from stratalens.operators.relate import with_name_scores


def test_type_hint_kinds(spark):
    rows = [("00123", "12", "Y", "1.5", "20250105", "x1"), ("00124", "13", "N", "2", "20250106", "x2"),
            ("125", "-4", "Y", "3.25", "20250107", "x3"), ("126", "15", "N", "4", "20250108", "x4")]
    df = spark.createDataFrame(rows, "acct_no string, qty string, active string, rate string, posting_dt string, other string")
    p = {r["column_name"]: r for r in P.profile({"t": df}).collect()}
    assert p["acct_no"]["hint_type"] is None and p["acct_no"]["leading_zero_count"] == 2 and "leading_zeros" in p["acct_no"]["flags"]
    assert [p[c]["hint_type"] for c in ("qty", "active", "rate", "posting_dt", "other")] == ["BIGINT", "BOOLEAN", "DECIMAL", "DATE", None]
    assert [tuple(f) for f in p["posting_dt"]["date_formats"]] == [("%Y%m%d", 1.0)]


def test_long_texts_are_counted_whole(spark):
    same = "a" * 300
    texts = [same + "x", same + "y", same + "x", " " * 400, " " * 300 + "N/A", "w" * 290 + "@x.org"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    p = P.profile({"t": df}).first()
    assert p["distinct_count"] == 5 and p["blank_count"] == 1 and p["placeholder_count"] == 1
    assert p["max_len"] == 400 and p["min_len"] == 296 and p["email_rows"] == 1
    assert p["top_values"][0]["n"] == 2 and p["top_values"][0]["value"] == "a" * 200 + "…"


def test_nulls_empty_and_decimals(spark):
    df = spark.createDataFrame([(None, "1.50"), (None, "2.25"), (None, None)], "nothing string, d string").withColumn("d", F.col("d").cast("decimal(10,2)"))
    p = {r["column_name"]: r for r in P.profile({"t": df}).collect()}
    assert "all_null" in p["nothing"]["flags"] and p["nothing"]["null_count"] == 3
    assert "unique_with_nulls" in p["d"]["flags"] and p["d"]["mean"] == 1.875
    empty = P.profile({"t": df.limit(0)}).collect()
    assert {r["row_count"] for r in empty} == {0}


def test_quantiles_in_ranges_match_one_window(spark):
    rng = random.Random(3)
    rows = [(c, float(v), rng.randint(1, 9)) for c in (1, 2) for v in rng.sample(range(10000), 700)]
    df = spark.createDataFrame(rows, "col_id int, num double, n int")
    for discrete in (False, True):
        whole = sorted(map(tuple, quantiles(df, [0.1, 0.25, 0.5, 0.99], discrete).collect()))
        parts = sorted(map(tuple, quantiles(df, [0.1, 0.25, 0.5, 0.99], discrete, window_rows=10).collect()))
        assert whole == parts
    values = sorted(v for c, v, n in rows if c == 1 for _ in range(n))
    at = 0.25 * (len(values) - 1)
    low = values[int(at)]
    assert whole and abs(quantiles(df, [0.25]).where("col_id = 1").first()["q0"] - (low + (at % 1) * (values[int(at) + 1] - low))) < 1e-9


def test_pattern_regex_matches_values(spark):
    values = ["AB-12 x", "a.b@c.de", "(06) 123", "G00000001", "héllo+1"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for v, regex in df.select("v", V.pattern_regex(V.shape(F.col("v")))).collect():
        assert re.match(regex, v), (v, regex)
    assert df.where("v = 'G00000001'").select(V.pattern_regex(V.shape(F.col("v")))).first()[0] == "^[A-Z][0-9]{8}$"


def test_similarity():
    assert round(S.jaro_winkler("martha", "marhta"), 4) == 0.9611 and round(S.jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert round(S.jaro_winkler("rossi", "rossie"), 4) == 0.9667 and S.jaro_winkler("", "") == 0.0
    assert S.ratio("abc", "abc") == 100 and round(S.ratio("this is a test", "this is a test!"), 2) == 96.55
    assert S.partial_ratio("test", "this is a test!") == 100 and S.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert S.weighted_ratio("MACHINERY", "MACHINES") >= 80 > S.weighted_ratio("MACHINES", "FURNITURE")

    def lcs(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        return rows[-1][-1]

    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for _ in range(2))
        assert abs(S.ratio(a, b) - 200 * lcs(a, b) / (len(a) + len(b))) < 1e-9


def test_name_scores(spark):
    expected = {("guest_id", "guest", "id"): 1.0, ("doc_id", "documents", "doc_id"): 1.0, ("n_regionkey", "region", "r_regionkey"): 0.9,
                ("o_custkey", "customer", "c_custkey"): 0.875, ("l_orderkey", "orders", "o_orderkey"): 0.889, ("status", "order", "status"): 0.8,
                ("property", "pms_properties", "property_id"): 0.9, ("class_id", "class", "id"): 1.0}
    pairs = spark.createDataFrame(list(expected), "from_column string, to_table string, to_column string")
    assert {tuple(r)[:3]: r["name_score"] for r in with_name_scores(pairs).collect()} == expected


def test_masking(spark):
    df = spark.createDataFrame([("a@b.org",), ("plain",), (None,), ("pii_done",)], "v string")
    got = [r[0] for r in df.select(mask_value(F.col("v"), "s", True)).collect()]
    token = "pii_" + hashlib.sha256(b"sa@b.org").hexdigest()[:16]
    assert got == [token + "@b.org", mask_text("plain", "s"), None, "pii_done"] and got[0] == mask_text("a@b.org", "s", True)


PII_NAMES = [
    ("t", "EmailAddress", "string", [], "", True), ("t", "BirthDate", "temporal", [], "", True), ("t", "CardNumber", "string", [], "", True),
    ("t", "EmailAddressID", "numeric", [], "", False), ("t", "EmailTypeCode", "string", [], "", False), ("t", "PostalCode", "string", [], "", False),
    ("t", "InsertDate", "temporal", [], "", False), ("t", "FirstName", "string", [], "no-pii", False), ("t", "Remarks", "string", [], "PII, contact", True),
    ("property", "PhoneNumber", "string", [], "", False), ("phonenumber", "PhoneNumber", "string", [], "", True), ("profile", "TaxID2", "string", [], "", True),
    ("t", "Value", "string", ["pii_email"], "", True), ("t", "IsEmailOptIn", "string", [], "", False), ("t", "BirthDay", "numeric", [], "", True)]


def test_pii_names(spark):
    df = spark.createDataFrame([x[:5] + (x[5],) for x in PII_NAMES], "t string, c string, f string, flags array<string>, tags string, masked boolean")
    reason = pii_reason(F.col("c"), F.col("f"), F.col("flags"), F.col("tags"), F.col("t"))
    wrong = df.where(reason.isNotNull() != F.col("masked")).collect()
    assert not wrong
