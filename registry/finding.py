"""Lookups, searches, breakdowns, samples, masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import STAR, VIEWS, columns_of, query, table, tables, union_sql, view, with_views
from stratalens.operators import lookup as L
from stratalens.operators import privacy as V
from stratalens.operators.profile import count_values, profile
from stratalens.operators.value_freq import union_all

SALT = "pepper"


@query("sample_rows")
def sample_rows(spark, sf):
    """Repeatable random rows of what matches a filter."""
    return L.sample_rows(table(spark, sf, "lineitem"), 500, not_null=["l_shipdate"], where="l_quantity > 40", seed=7)[0]


@query("sample_matched", "SELECT count(*) AS matched FROM lineitem WHERE l_quantity > 40")
def sample_matched(spark, sf):
    return L.sample_rows(table(spark, sf, "lineitem"), 500, where="l_quantity > 40", seed=7)[1]


_PREDICATES = [
    ("orders", "o_orderpriority", "=", ["1-urgent", "5-Low"], "lower(trim(o_orderpriority)) IN ('1-urgent', '5-low')"),
    ("orders", "o_orderpriority", "!=", ["1-URGENT"], "lower(trim(o_orderpriority)) NOT IN ('1-urgent')"),
    ("orders", "o_orderpriority", "~", ["not spec"], "o_orderpriority ILIKE '%not spec%'"),
    ("orders", "o_custkey", "=", ["17", "18.0", "1199"], "o_custkey IN (17, 18, 1199)"),
    ("orders", "o_totalprice", ">", ["400000.5"], "o_totalprice > 400000.5"),
    ("orders", "o_custkey", "<=", ["100"], "o_custkey <= 100"),
    ("orders", "o_orderdate", "=", ["1998-05", "1999-01-02"], "CAST(o_orderdate AS VARCHAR) LIKE '1998-05%' OR CAST(o_orderdate AS VARCHAR) LIKE '1999-01-02%'"),
    ("orders", "o_orderdate", "!=", ["1998-05-03"], "CAST(o_orderdate AS VARCHAR) NOT LIKE '1998-05-03%'"),
    ("orders", "o_orderdate", ">=", ["2000-06-01"], "o_orderdate >= TIMESTAMP '2000-06-01'"),
    ("documents", "text", "~", ["the"], "text ILIKE '%the%'"),
    ("orders_sparse", "note_txt", "!=", ["n/a"], "lower(trim(note_txt)) NOT IN ('n/a')"),
    ("orders_sparse", "cancel_code", "=", ["c1", " C2"], "lower(trim(cancel_code)) IN ('c1', ' c2')"),
]


@query("filter_predicate", with_views("orders_sparse") + union_sql([
    f"SELECT {i}::INTEGER AS predicate, count(*) AS matches FROM {t} WHERE {sql}" for i, (t, _, _, _, sql) in enumerate(_PREDICATES)]))
def filter_predicate(spark, sf):
    parts = []
    for i, (t, column, op, values, _) in enumerate(_PREDICATES):
        df = view(spark, sf, t) if t in VIEWS else table(spark, sf, t)
        found = df.where(L.filter_predicate(df, column, op, values))
        parts.append(found.agg(F.count(F.lit(1)).alias("matches")).select(F.lit(i).alias("predicate"), "matches"))
    return union_all(parts)


@query("multi_table_lookup", """
    SELECT 'orders' AS table_name, count(*) AS matches FROM orders WHERE o_orderkey IN (401, 77) OR o_custkey IN (401, 77)
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (401, 77)
    UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey IN (401, 77)""")
def multi_table_lookup(spark, sf):
    targets = {"orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey"], "customer": ["c_custkey"]}
    counts, _ = L.multi_table_lookup(tables(spark, sf, *targets), targets, "=", "401, '77'")
    return counts.drop("schema_name")


@query("lookup_rows")
def lookup_rows(spark, sf):
    """Matching rows of several tables as JSON."""
    targets = {"orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey"], "customer": ["c_custkey"]}
    return L.multi_table_lookup(tables(spark, sf, *targets), targets, "=", "401", limit=50)[1]


@query("lookup_masked", with_views("people") + "SELECT 'people' AS table_name, count(*) AS matches FROM people WHERE email_address = 'guest25@example.com'")
def lookup_masked(spark, sf):
    """A typed e-mail finds its row in the masked table."""
    masked = V.mask_pii(view(spark, sf, "people"), {"email_address": "email"}, SALT)
    counts, _ = L.multi_table_lookup({"people": masked}, {"people": ["email_address"]}, "=", "guest25@example.com",
                                     masked={"people": {"email_address": "email"}}, salt=SALT)
    return counts.drop("schema_name")


def _search_sql(text: str, number: str | None) -> str:
    parts = []
    for t, c, kind in columns_of(*STAR, "events", "documents", "conversations"):
        test = {"s": f"{c} ILIKE '%{text}%'", "t": f"CAST({c} AS VARCHAR) LIKE '{text}%'" if text[:4].isdigit() and len(text) > 7 else None}.get(
            kind, f"{c} = {number}" if number else None)
        if test:
            parts.append(f"""SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS hits,
                (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {t} WHERE {test} ORDER BY 1 LIMIT 3)) AS examples
                FROM {t} WHERE {test} HAVING count(*) > 0""")
    return union_sql(parts)


def _search(spark, sf, text):
    found = L.value_search(tables(spark, sf, *STAR, "events", "documents", "conversations"), text)
    return found.select("table_name", "column_name", "hits", F.array_join("examples", "|").alias("examples"))


@query("value_search", _search_sql("17", "17"))
def value_search(spark, sf):
    """Which columns of which tables contain 17, as number or within text; whole texts are searched."""
    return _search(spark, sf, "17")


@query("value_search_date", _search_sql("1998-05-17", None))
def value_search_date(spark, sf):
    return _search(spark, sf, "1998-05-17")


@query("value_search_exact", union_sql([
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS hits FROM {t} WHERE lower({c}) = 'building' HAVING count(*) > 0"
    for t, c, _ in columns_of(*STAR, kinds="s")]))
def value_search_exact(spark, sf):
    """Exact search over stored value counts instead of the tables."""
    counted = count_values(tables(spark, sf, *STAR))
    return L.value_search_counted(counted, "BUILDING", exact=True).select("table_name", "column_name", "hits")


@query("value_search_long", """
    SELECT 'documents' AS table_name, 'text' AS column_name, count(*) AS hits FROM documents WHERE contains(lower(text), 'license') HAVING count(*) > 0
    UNION ALL SELECT 'pages', 'html', count(*) FROM pages WHERE contains(lower(html), 'license') HAVING count(*) > 0
    UNION ALL SELECT 'pages', 'url', count(*) FROM pages WHERE contains(lower(url), 'license') HAVING count(*) > 0
    UNION ALL SELECT 'conversations', 'text', count(*) FROM conversations WHERE contains(lower(text), 'license') HAVING count(*) > 0""")
def value_search_long(spark, sf):
    """Search over counts finds words anywhere in long texts."""
    counted = count_values(tables(spark, sf, "documents", "pages", "conversations"))
    return L.value_search_counted(counted, "license").select("table_name", "column_name", "hits")


@query("breakdown", with_views("orders_sparse") + """
    SELECT o_orderstatus AS by_value, count(*) AS row_count, count(cancel_code) AS filled, round(100.0 * count(cancel_code) / count(*), 1) AS filled_pct,
           count(DISTINCT cancel_code) AS distinct_values,
           (SELECT cancel_code FROM orders_sparse i WHERE i.o_orderstatus = o.o_orderstatus AND cancel_code IS NOT NULL GROUP BY 1
            ORDER BY count(*) DESC, cancel_code LIMIT 1) AS most_common
    FROM orders_sparse o GROUP BY 1""")
def breakdown(spark, sf):
    return L.breakdown(view(spark, sf, "orders_sparse"), "cancel_code", "o_orderstatus")


@query("adhoc_sql", """
    SELECT o_orderpriority, o_orderstatus, count(*) AS n, FALSE AS truncated FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2""")
def adhoc_sql(spark, sf):
    return L.adhoc_sql(spark, tables(spark, sf, "orders", "customer"), """
        SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2""")


_MASKED = """
    SELECT person_id, CASE WHEN email_address IS NOT NULL THEN 'pii_' || left(sha256('pepper' || email_address), 16) || '@' || split_part(email_address, '@', -1) END AS email_address,
           'pii_' || left(sha256('pepper' || last_name), 16) AS last_name, 'pii_' || left(sha256('pepper' || mobile_phone), 16) AS mobile_phone FROM people"""
_KINDS = {"email_address": "email", "last_name": "other", "mobile_phone": "other"}


@query("mask_pii", with_views("people") + _MASKED)
def mask_pii(spark, sf):
    return V.mask_pii(view(spark, sf, "people"), _KINDS, SALT).select("person_id", *_KINDS)


@query("mask_twice", with_views("people") + _MASKED)
def mask_twice(spark, sf):
    """Masking again changes nothing."""
    once = V.mask_pii(view(spark, sf, "people"), _KINDS, SALT)
    return V.mask_pii(once, _KINDS, SALT).select("person_id", *_KINDS)


@query("mask_value_counts", with_views("people") + """
, m AS (SELECT person_id, 'pii_' || left(sha256('pepper' || last_name), 16) AS last_name,
        'pii_' || left(sha256('pepper' || email_address), 16) || '@' || split_part(email_address, '@', -1) AS email_address,
        'pii_' || left(sha256('pepper' || repeat(last_name || ' ', 60)), 16) AS letter, first_name FROM people),
    v AS (SELECT 'last_name' AS column_name, last_name AS value FROM m UNION ALL SELECT 'email_address', email_address FROM m
        UNION ALL SELECT 'letter', letter FROM m UNION ALL SELECT 'first_name', first_name FROM m)
    SELECT column_name, value, trim(value) AS trimmed, length(value) AS text_len, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY 1, 2""")
def mask_value_counts(spark, sf):
    """Counts of masked columns, one with long texts, and of one that isn't masked; all columns that are made of a value."""
    people = view(spark, sf, "people").withColumn("letter", F.repeat(F.concat("last_name", F.lit(" ")), 60)).select("last_name", "email_address", "letter", "first_name")
    counted = V.masked_counts({"people": people}, {"people": {"last_name": "other", "email_address": "email", "letter": "other"}}, SALT)
    return counted.freq.join(counted.columns.select("col_id", "column_name"), "col_id").select("column_name", "value", "trimmed", "text_len", "n")


@query("mask_profile", with_views("people") + """, m AS (SELECT 'pii_' || left(sha256('pepper' || last_name), 16) AS last_name,
        'pii_' || left(sha256('pepper' || mobile_phone), 16) AS mobile_phone FROM people)
    SELECT 'last_name' AS column_name, count(DISTINCT last_name) AS distinct_count, min(last_name) AS min_val, max(last_name) AS max_val FROM m
    UNION ALL SELECT 'mobile_phone', count(DISTINCT mobile_phone), min(mobile_phone), max(mobile_phone) FROM m""")
def mask_profile(spark, sf):
    """The profile of masked columns knows tokens only."""
    kinds = {"people": {"last_name": "other", "mobile_phone": "other"}}
    counted = V.masked_counts({"people": view(spark, sf, "people").select("last_name", "mobile_phone")}, kinds, SALT)
    return profile(counted.tables, counted=counted).select("column_name", "distinct_count", "min_val", "max_val")


@query("pii_columns", with_views("people") + union_sql([
    "SELECT 'people' AS table_name, 'first_name' AS column_name, 'other' AS kind, 'name looks like personal data' AS reason FROM people HAVING count(first_name) > 0",
    "SELECT 'people', 'last_name', 'other', 'name looks like personal data' FROM people HAVING count(last_name) > 0",
    "SELECT 'people', 'birth_date', 'other', 'name looks like personal data' FROM people HAVING count(birth_date) > 0",
    """SELECT 'people', 'email_address', 'email', 'values look like e-mail addresses' FROM people WHERE email_address IS NOT NULL
       HAVING avg(CASE WHEN regexp_matches(email_address, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN 1 ELSE 0 END) > 0.8""",
    """SELECT 'people', 'mobile_phone', 'other', 'values look like phone numbers' FROM people
       HAVING avg(CASE WHEN regexp_matches(mobile_phone, '^\\+?\\(?[0-9][0-9 ()\\-.]{6,}$') THEN 1 ELSE 0 END) > 0.8"""]))
def pii_columns(spark, sf):
    p = profile({"people": view(spark, sf, "people"), **tables(spark, sf, "orders", "customer")})
    return V.pii_columns(p.withColumn("tags", F.lit(""))).drop("schema_name")


@query("mask_display", with_views("people") + """
    SELECT person_id, CASE WHEN email_address IS NOT NULL THEN '••••••' END AS email_address, '••••••' AS last_name FROM people""")
def mask_display(spark, sf):
    return V.mask_display(view(spark, sf, "people"), ["email_address", "last_name"]).select("person_id", "email_address", "last_name")
