"""Relationship discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registry.core import STAR, query, table, tables, union_sql, view, with_views
from stratalens.functions.similarity import partial_ratio_udf, ratio_udf, token_set_ratio_udf, weighted_ratio_udf
from stratalens.operators import relate as R
from stratalens.operators.profile import count_values, profile
from stratalens.operators.value_freq import meta_of
from stratalens.sources.sampling import key_sample, plan_key_samples

# child table and key, parent table and key, name score
LINKS = [
    ("orders", "o_custkey", "customer", "c_custkey", 0.875), ("lineitem", "l_orderkey", "orders", "o_orderkey", 0.889),
    ("lineitem", "l_partkey", "part", "p_partkey", 0.875), ("lineitem", "l_suppkey", "supplier", "s_suppkey", 0.875),
    ("customer", "c_nationkey", "nation", "n_nationkey", 0.9), ("supplier", "s_nationkey", "nation", "n_nationkey", 0.9),
    ("nation", "n_regionkey", "region", "r_regionkey", 0.9), ("labels", "doc_id", "documents", "doc_id", 1.0),
]
NAMES = [*STAR, "labels", "documents"]
# links that must be measured although they are weak or broken
PLANTED = [("lineitem_orphan", "l_partkey", "part", "p_partkey"), ("lineitem_orphan", "l_suppkey", "supplier", "s_suppkey"),
           ("events", "user_id", "customer", "c_custkey"), ("lineitem_orphan", "l_orderkey", "lineitem_orphan", "l_orderkey")]


def _inputs(spark, sf) -> dict[str, DataFrame]:
    return {**tables(spark, sf, *NAMES), "lineitem_orphan": view(spark, sf, "lineitem_orphan"), "events": table(spark, sf, "events")}


def _pairs(counted, wanted) -> DataFrame:
    ids = {(m.table_name, m.column_name): m.col_id for m in counted.metas}
    rows = [(ids[c, fk], ids[p, pk], c, fk, p, pk) for c, fk, p, pk, *_ in wanted]
    return counted.spark.createDataFrame(
        rows, "from_id int, to_id int, from_table string, from_column string, to_table string, to_column string")


def _key_counts(spark, sf, wanted):
    """Value counts of the key columns only."""
    named = _inputs(spark, sf)
    keys: dict[str, list[str]] = {}
    for c, fk, p, pk, *_ in wanted:
        keys.setdefault(c, []).append(fk)
        keys.setdefault(p, []).append(pk)
    return count_values(named, meta_of(named, keys))


def _row_counts(counted) -> DataFrame:
    there = F.col("value").isNotNull()
    return counted.counts.groupBy("col_id").agg(
        F.sum("n").alias("row_count"), F.sum(F.when(there, 0).otherwise(F.col("n"))).alias("null_count"))


def _cardinality_sql(c, fk, p, pk) -> str:
    return f"""
        SELECT '{c}' AS from_table, '{fk}' AS from_column, '{p}' AS to_table, '{pk}' AS to_column,
               CASE WHEN parent_max > 1 THEN 'N:M' WHEN coalesce(child_max, 0) <= 1 THEN '1:1' ELSE '1:N' END AS cardinality,
               round(child_avg, 2) AS child_avg, coalesce(child_max, 0) AS child_max,
               round(coalesce(100.0 * childless / parents, 0), 2) AS parent_no_child_pct,
               (SELECT round(100.0 * count(*) FILTER (WHERE {fk} IS NULL) / count(*), 2) FROM {c}) AS fk_null_pct,
               (SELECT count(*) FROM {c} WHERE {fk} IS NOT NULL AND {fk} NOT IN (SELECT {pk} FROM {p} WHERE {pk} IS NOT NULL)) AS orphan_rows
        FROM (SELECT max(pn) AS parent_max, max(cn) AS child_max, avg(cn) AS child_avg, count(*) AS parents,
                     count(*) FILTER (WHERE cn IS NULL) AS childless
              FROM (SELECT {pk} AS k, count(*) AS pn FROM {p} WHERE {pk} IS NOT NULL GROUP BY 1) pa
              LEFT JOIN (SELECT {fk} AS k, count(*) AS cn FROM {c} WHERE {fk} IS NOT NULL GROUP BY 1) ch USING (k))"""


NAMED = ["from_table", "from_column", "to_table", "to_column"]


@query("name_similarity")
def name_similarity(spark, sf):
    """Name scores of all candidate pairs of columns, and the string scores they rest on."""
    p = profile(tables(spark, sf, *NAMES))
    pairs = R.relationship_candidates(p, name_threshold=0.0)
    a, b = F.lower("from_column"), F.lower("to_column")
    return pairs.select(*NAMED, "name_score", F.round(ratio_udf(a, b), 2).alias("ratio"), F.round(partial_ratio_udf(a, b), 2).alias("partial"),
                        F.round(token_set_ratio_udf(a, b), 2).alias("token_set"), F.round(weighted_ratio_udf(a, b), 2).alias("weighted"))


_GIVEN_SCORES = ", ".join(f"('{fk}', '{p}', '{pk}', {s})" for _, fk, p, pk, s in LINKS)
_KEYS = {"customer": ["c_custkey", "c_nationkey"], "orders": ["o_orderkey", "o_custkey"], "nation": ["n_nationkey", "n_regionkey"],
         "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "region": ["r_regionkey"], "part": ["p_partkey"],
         "supplier": ["s_suppkey", "s_nationkey"], "labels": ["doc_id"], "documents": ["doc_id"]}


@query("relationship_candidates", f"""
    WITH d AS ({union_sql([f"SELECT '{t}' AS t, '{c}' AS c, count({c}) AS nn, count(DISTINCT {c}) AS d FROM {t}"
                           for t, cs in _KEYS.items() for c in cs])}),
         s(from_column, to_table, to_column, name_score) AS (VALUES {_GIVEN_SCORES})
    SELECT f.t AS from_table, f.c AS from_column, g.t AS to_table, g.c AS to_column, CAST(name_score AS DOUBLE) AS name_score
    FROM d f JOIN d g ON f.t <> g.t AND g.d >= 2 AND g.d >= 0.98 * g.nn AND f.d <= 1.02 * g.d AND f.d > 1
    JOIN s ON s.from_column = f.c AND s.to_table = g.t AND s.to_column = g.c
    WHERE NOT (f.d = f.nn AND name_score < 0.9)""")
def relationship_candidates(spark, sf):
    """Candidates given the name scores (the scores themselves are tested apart)."""
    p = profile(tables(spark, sf, *NAMES))
    scores = spark.createDataFrame([(fk, p_, pk, s) for _, fk, p_, pk, s in LINKS],
                                   "from_column string, to_table string, to_column string, name_score double")
    return R.relationship_candidates(p, scores=scores).select(*NAMED, "name_score")


@query("value_overlap", with_views("lineitem_orphan") + union_sql([
    f"""SELECT '{c}' AS from_table, '{fk}' AS from_column, '{p}' AS to_table, '{pk}' AS to_column, count(*) AS from_distinct,
        count(*) FILTER (WHERE k IN (SELECT {pk} FROM {p})) AS matched_distinct
        FROM (SELECT DISTINCT {fk} AS k FROM {c} WHERE {fk} IS NOT NULL)""" for c, fk, p, pk, *_ in LINKS + PLANTED]))
def value_overlap(spark, sf):
    counted = _key_counts(spark, sf, LINKS + PLANTED)
    pairs = _pairs(counted, LINKS + PLANTED)
    return R.value_overlap(counted.freq, pairs).join(pairs, ["from_id", "to_id"]).select(*NAMED, "from_distinct", "matched_distinct")


@query("overlap_report", with_views("lineitem_orphan") + union_sql([
    f"""SELECT '{c}' AS from_table, '{fk}' AS from_column, '{p}' AS to_table, '{pk}' AS to_column, a AS left_distinct, m AS left_in_right,
        round(100.0 * m / a, 2) AS left_in_right_pct, b AS right_distinct, m AS right_in_left, round(100.0 * m / b, 2) AS right_in_left_pct,
        coalesce((SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT CAST({fk} AS VARCHAR) AS v FROM {c} WHERE {fk} IS NOT NULL
                  AND {fk} NOT IN (SELECT {pk} FROM {p}) ORDER BY v LIMIT 10)), '') AS left_orphans
        FROM (SELECT (SELECT count(DISTINCT {fk}) FROM {c}) AS a, (SELECT count(DISTINCT {pk}) FROM {p}) AS b,
                     (SELECT count(DISTINCT {fk}) FROM {c} WHERE {fk} IN (SELECT {pk} FROM {p})) AS m)"""
    for c, fk, p, pk, *_ in LINKS + PLANTED[:3]]))
def overlap_report(spark, sf):
    counted = _key_counts(spark, sf, LINKS + PLANTED[:3])
    report = R.overlap_report(counted.freq, _pairs(counted, LINKS + PLANTED[:3]), _row_counts(counted))
    return report.select(*NAMED, "left_distinct", "left_in_right", "left_in_right_pct", "right_distinct", "right_in_left",
                         "right_in_left_pct", F.array_join("left_orphans", ",").alias("left_orphans"))


@query("cardinality", with_views("lineitem_orphan") + union_sql([_cardinality_sql(*x[:4]) for x in LINKS + PLANTED]))
def cardinality(spark, sf):
    counted = _key_counts(spark, sf, LINKS + PLANTED)
    pairs = _pairs(counted, LINKS + PLANTED)
    measured = R.cardinality(counted.freq, pairs, _row_counts(counted))
    return measured.join(pairs, ["from_id", "to_id"]).drop("from_id", "to_id")


@query("discover_relationships", union_sql([
    f"""SELECT *, round(100.0 * m / a, 2) AS overlap_pct, a AS from_distinct, m AS matched_distinct,
        round(0.65 * (m / a) + 0.35 * {score}, 3) AS confidence, CAST({score} AS DOUBLE) AS name_score
        FROM ({_cardinality_sql(c, fk, p, pk)}),
             (SELECT (SELECT count(DISTINCT {fk}) FROM {c}) AS a, (SELECT count(DISTINCT {fk}) FROM {c} WHERE {fk} IN (SELECT {pk} FROM {p})) AS m)"""
    for c, fk, p, pk, score in LINKS]).replace("SELECT *,", "SELECT * EXCLUDE (a, m),"))
def discover_relationships(spark, sf):
    """All foreign-key links between the tables, found from names and values."""
    links = R.find_links(tables(spark, sf, *NAMES))
    return links.drop("from_id", "to_id", "from_schema", "to_schema", "summary", "method")


@query("refresh_cardinality", with_views("lineitem_orphan") + union_sql([_cardinality_sql(*x[:4]) for x in PLANTED[:2]]))
def refresh_cardinality(spark, sf):
    """Links stored for the clean table, measured again on the one with orphans and empty keys."""
    counted = _key_counts(spark, sf, PLANTED[:2])
    old = ["cardinality", "child_avg", "child_max", "parent_no_child_pct", "fk_null_pct", "orphan_rows", "summary"]
    stored = _pairs(counted, PLANTED[:2]).select("*", *[F.lit(None).cast("string").alias(c) for c in old])
    return R.refresh_cardinality(stored, counted.freq, _row_counts(counted)).drop("from_id", "to_id", "summary")


@query("orphan_rows", with_views("lineitem_orphan") + """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem_orphan
    WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part)""")
def orphan_rows(spark, sf):
    return R.orphan_rows(view(spark, sf, "lineitem_orphan"), "l_partkey", table(spark, sf, "part"), "p_partkey")


_SENTENCES = [LINKS[0], LINKS[7], *PLANTED[:2]]


@query("relationship_sentence", with_views("lineitem_orphan") + f"""
    SELECT from_table, from_column, upper(left(s, 1)) || substr(s, 2) || '; ' ||
           CASE WHEN fk_null_pct > 0 THEN format('{{:g}}', fk_null_pct) || '% of ' || from_table || ' rows have no ' || from_column || ' (optional)'
                ELSE from_column || ' is always filled (mandatory)' END ||
           CASE WHEN orphan_rows > 0 THEN '; ' || format('{{:,}}', orphan_rows) || ' ' || from_table || ' rows point to a ' || to_table
                || ' that doesn''t exist' ELSE '' END || '.' AS sentence
    FROM (SELECT *, CASE cardinality WHEN 'N:M' THEN to_table || '.' || to_column || ' is not unique, so this is many-to-many (or the wrong target column)'
            WHEN '1:1' THEN 'each ' || to_table || CASE WHEN parent_no_child_pct > 0 THEN ' has at most one ' ELSE ' has exactly one ' END || from_table
            ELSE 'each ' || to_table || ' has ' || CASE WHEN parent_no_child_pct > 0 THEN '0' ELSE '1' END || '–' || format('{{:,}}', child_max) || ' '
                 || from_table || ' (' || format('{{:g}}', child_avg) || ' on average)' END AS s
          FROM ({union_sql([_cardinality_sql(*x[:4]) for x in _SENTENCES])}))""")
def relationship_sentence(spark, sf):
    counted = _key_counts(spark, sf, _SENTENCES)
    pairs = _pairs(counted, _SENTENCES)
    measured = R.cardinality(counted.freq, pairs, _row_counts(counted)).join(pairs, ["from_id", "to_id"])
    return measured.select("from_table", "from_column", R.relationship_sentence().alias("sentence"))


@query("plan_key_samples", """
    SELECT 'lineitem' AS child, 'orders' AS parent, 0::BIGINT AS new_orphans, TRUE AS is_smaller
    UNION ALL SELECT 'orders', 'customer', 0, TRUE WHERE FALSE""")
def key_samples(spark, sf):
    """Samples of linked tables on the same key range: no sampled child row loses its parent."""
    links = [{"from_schema": "main", "from_table": c, "from_column": fk, "to_schema": "main", "to_table": p, "to_column": pk,
              "confidence": 0.65 + 0.35 * s} for c, fk, p, pk, s in LINKS]
    child, parent = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    sizes = {"main.lineitem": child.count(), "main.orders": parent.count()}
    plan = plan_key_samples(links, sizes, {t: n // 4 for t, n in sizes.items()})
    a = key_sample(child, plan["main.lineitem"]["column"], plan["main.lineitem"]["ppm"])
    b = key_sample(parent, plan["main.orders"]["column"], plan["main.orders"]["ppm"])
    lost = R.orphan_rows(a, "l_orderkey", b, "o_orderkey").agg(F.count(F.lit(1)).alias("new_orphans"))
    smaller = a.agg(F.count(F.lit(1)).alias("n"))
    kept = smaller.first()["n"]
    return lost.select(F.lit("lineitem").alias("child"), F.lit("orders").alias("parent"), "new_orphans",
                       F.lit(0 < kept < sizes["main.lineitem"]).alias("is_smaller"))
