"""Data-quality rules: suggestion, evaluation, export."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import query, table, tables, union_sql, view, with_views
from registry.linking import LINKS
from stratalens.functions import values as V
from stratalens.operators import export as X
from stratalens.operators import rules as Q
from stratalens.plans.analysis import analyse

_INPUT = ["nation", "customer", "orders"]


_PLANTED = ["orders_sparse", "charges", "orders_txt"]


def _rules(spark, sf, *names):
    """The rules suggested for these tables."""
    return analyse({n: (view if n in _PLANTED else table)(spark, sf, n) for n in names}).rules


_COLUMNS = {"nation": {"n_nationkey": "i", "n_name": "s", "n_regionkey": "i"},
            "customer": {"c_custkey": "i", "c_name": "s", "c_nationkey": "i", "c_acctbal": "d", "c_mktsegment": "s"},
            "orders": {"o_orderkey": "i", "o_custkey": "i", "o_orderstatus": "s", "o_totalprice": "d", "o_orderdate": "t", "o_orderpriority": "s"}}
_ALL = [(t, c, k) for t, cs in _COLUMNS.items() for c, k in cs.items()]


@query("suggest_not_null", union_sql([
    f"""SELECT '{t}' AS table_name, '{c}' AS column_name, '{'not_empty' if k == 's' else 'not_null'}' AS rule, 'error' AS criticality
        FROM {t} HAVING count({c}) = count(*)""" for t, c, k in _ALL]))
def suggest_not_null(spark, sf):
    rules = _rules(spark, sf, *_INPUT).where(F.col("rule").isin("not_null", "not_empty") & F.col("table_name").isin(_INPUT))
    return rules.select("table_name", F.col("columns")[0].alias("column_name"), "rule", "criticality")


@query("suggest_in_list", union_sql([
    f"""SELECT '{t}' AS table_name, '{c}' AS column_name, array_to_string(list(v ORDER BY n DESC, v), '|') AS allowed, 'a code list of ' || count(*) || ' values' AS reason
        FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {t} GROUP BY 1) HAVING count(*) BETWEEN 2 AND 50"""
    for t, c in [("nation", "n_regionkey"), ("customer", "c_mktsegment"), ("orders", "o_orderstatus"), ("orders", "o_orderpriority")]
]).replace("FROM (SELECT CAST(n_regionkey AS VARCHAR) AS v, count(*) AS n FROM nation", "FROM (SELECT CAST(n_regionkey AS VARCHAR) AS v, count(*) AS n FROM nation WHERE n_regionkey NOT IN (0, -1)")
    .replace("HAVING count(*) BETWEEN 2 AND 50\nUNION ALL\nSELECT 'customer'", "HAVING count(*) < 0\nUNION ALL\nSELECT 'customer'"))
def suggest_in_list(spark, sf):
    """Code lists as allowed values; n_regionkey and c_nationkey hold the placeholder 0 and get none."""
    rules = _rules(spark, sf, *_INPUT).where((F.col("rule") == "in_list") & F.col("table_name").isin(_INPUT))
    return rules.select("table_name", F.col("columns")[0].alias("column_name"), F.array_join("allowed", "|").alias("allowed"), "reason")


@query("suggest_ranges", with_views("charges") + """
    SELECT 'non_negative' AS rule, 'amount' AS column_name, 'warn' AS criticality, round(100 * (1 - count(*) FILTER (WHERE amount < 0) / count(*)), 2) AS passing_pct,
           0.0::DOUBLE AS min_limit, NULL::DOUBLE AS max_limit FROM charges
    UNION ALL
    SELECT 'range', 'amount', 'warn', round(100 * (1 - count(*) FILTER (WHERE amount < lo OR amount > hi) / count(*)), 2), round(min(lo), 2), round(min(hi), 2)
    FROM charges, (SELECT round(a - 3 * (b - a), 6) AS lo, round(b + 3 * (b - a), 6) AS hi FROM (
        SELECT quantile_cont(amount, 0.25) AS a, quantile_cont(amount, 0.75) AS b FROM charges))""")
def suggest_ranges(spark, sf):
    rules = _rules(spark, sf, "charges").where((F.col("table_name") == "charges") & F.col("rule").isin("non_negative", "range"))
    return rules.select("rule", F.col("columns")[0].alias("column_name"), "criticality", "passing_pct", "min_limit", "max_limit")


@query("suggest_keys", union_sql([
    f"SELECT '{t}' AS table_name, 'unique' AS rule, '{c}' AS columns, 100.0::DOUBLE AS passing_pct FROM {t} HAVING count(DISTINCT {c}) = count(*)"
    for t, c in [("nation", "n_nationkey"), ("customer", "c_custkey"), ("orders", "o_orderkey")]]))
def suggest_keys(spark, sf):
    rules = _rules(spark, sf, *_INPUT).where(F.col("rule").isin("unique", "unique_combo") & F.col("table_name").isin(_INPUT))
    return rules.select("table_name", "rule", F.array_join("columns", "+").alias("columns"), "passing_pct")


@query("suggest_references", union_sql([
    f"""SELECT '{c}' AS table_name, '{fk}' AS column_name, 'main.{p}' AS ref_table, '{pk}' AS ref_column, 'error' AS criticality, 100.0::DOUBLE AS passing_pct
        FROM {c} HAVING count(*) FILTER (WHERE {fk} NOT IN (SELECT {pk} FROM {p})) = 0"""
    for c, fk, p, pk, _ in LINKS if c in _INPUT and p in _INPUT]))
def suggest_references(spark, sf):
    rules = _rules(spark, sf, *_INPUT).where((F.col("rule") == "foreign_key") & F.col("table_name").isin(_INPUT)
                                    & F.col("ref_table").isin([f"main.{t}" for t in _INPUT]))
    return rules.select("table_name", F.col("columns")[0].alias("column_name"), "ref_table", "ref_column", "criticality", "passing_pct")


@query("suggest_conditional", with_views("orders_sparse", "orders_txt") + """
    SELECT 'orders_sparse' AS table_name, 'filled_when' AS rule, c AS column_name, 'F' AS detail, 100.0::DOUBLE AS passing_pct
    FROM (SELECT unnest(['cancel_reason', 'cancel_code']) AS c FROM (SELECT 1 FROM orders_sparse LIMIT 1))
    UNION ALL SELECT 'orders_txt', 'filled_when', 'closed_on', 'Y', 100.0 FROM orders_txt HAVING count(*) > 0
    UNION ALL SELECT 'orders_txt', 'filled_when', 'agent_id', 'F,O', 100.0 FROM orders_txt HAVING count(*) > 0
    UNION ALL
    SELECT 'orders_txt', 'valid_date', 'order_dt_txt', 'yyyy-MM-dd', round(100 * round(iso / real_n, 4), 2)
    FROM (SELECT count(*) FILTER (WHERE try_strptime(order_dt_txt, '%Y-%m-%d') IS NOT NULL) AS iso,
                 count(*) FILTER (WHERE trim(order_dt_txt) NOT IN ('', 'N/A', '-', 'unknown')) AS real_n FROM orders_txt)""")
def suggest_conditional(spark, sf):
    rules = _rules(spark, sf, "orders_sparse", "orders_txt").where(F.col("rule").isin("filled_when", "valid_date"))
    detail = F.coalesce("date_format", F.array_join("when_values", ","))
    return rules.select("table_name", "rule", F.col("columns")[0].alias("column_name"), detail.alias("detail"), "passing_pct")


@query("suggest_rules")
def suggest_rules(spark, sf):
    """All suggested rules with reasons."""
    return _rules(spark, sf, *_INPUT, *_PLANTED)


@query("pattern_regex", """
    SELECT DISTINCT p_brand AS value, '^[A-Z][a-z]{4}\\#[0-9]' || CASE WHEN length(p_brand) = 8 THEN '{2}' ELSE '' END || '$' AS regex, TRUE AS fits FROM part""")
def pattern_regex(spark, sf):
    """Shapes of all values turned into patterns that the values match."""
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("value")).distinct()
    regex = V.pattern_regex(V.shape(F.col("value")))
    return brands.select("value", regex.alias("regex")).withColumn("fits", F.regexp_like("value", F.col("regex")))


@query("spark_date_format", with_views("orders_txt") + """
    SELECT CASE WHEN order_dt_txt LIKE '%/%' THEN '%d/%m/%Y' ELSE '%Y-%m-%d' END AS strftime,
           CASE WHEN order_dt_txt LIKE '%/%' THEN 'dd/MM/yyyy' ELSE 'yyyy-MM-dd' END AS pattern, count(*) AS n
    FROM orders_txt WHERE trim(order_dt_txt) NOT IN ('', 'N/A', '-', 'unknown') GROUP BY 1, 2""")
def spark_date_format(spark, sf):
    kind = V.value_kind("trim(order_dt_txt)", False)
    seen = view(spark, sf, "orders_txt").select(kind.alias("kind")).where("kind LIKE 'date:%'").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    strftime = F.substring("kind", 6, 20)
    return seen.select(strftime.alias("strftime"), V.spark_date_format_col(strftime).alias("pattern"), "n")


@query("evaluate_rules", with_views("lineitem_orphan", "orders_sparse", "charges", "orders_txt") + """
    SELECT 'lineitem_orphan' AS table_name, 'not_null' AS rule, 'l_suppkey' AS columns, count(*) AS row_count, count(*) FILTER (WHERE l_suppkey IS NULL) AS failing_rows FROM lineitem_orphan
    UNION ALL SELECT 'lineitem_orphan', 'foreign_key', 'l_partkey', count(*), count(*) FILTER (WHERE l_partkey NOT IN (SELECT p_partkey FROM part)) FROM lineitem_orphan
    UNION ALL SELECT 'lineitem_orphan', 'unique_combo', 'l_orderkey+l_linenumber', count(*), count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem_orphan
    UNION ALL SELECT 'charges', 'non_negative', 'amount', count(*), count(*) FILTER (WHERE amount < 0) FROM charges
    UNION ALL SELECT 'charges', 'range', 'amount', count(*), count(*) FILTER (WHERE amount < 0 OR amount > 200000) FROM charges
    UNION ALL SELECT 'charges', 'not_in_future', 'l_shipdate', count(*), count(*) FILTER (WHERE CAST(l_shipdate AS DATE) > current_date) FROM charges
    UNION ALL SELECT 'orders_sparse', 'filled_when', 'cancel_code', count(*), count(*) FILTER (WHERE o_orderpriority IN ('5-LOW') AND cancel_code IS NULL) FROM orders_sparse
    UNION ALL SELECT 'orders_sparse', 'in_list', 'cancel_code', count(*), count(*) FILTER (WHERE cancel_code NOT IN ('C1', 'C2')) FROM orders_sparse
    UNION ALL SELECT 'orders_sparse', 'regex', 'note_txt', count(*), count(*) FILTER (WHERE NOT regexp_matches(note_txt, '^note [0-9]+$')) FROM orders_sparse
    UNION ALL SELECT 'orders_txt', 'not_empty', 'order_dt_txt', count(*), count(*) FILTER (WHERE order_dt_txt IS NULL OR trim(order_dt_txt) = '') FROM orders_txt
    UNION ALL SELECT 'orders_txt', 'valid_date', 'order_dt_txt', count(*), count(*) FILTER (WHERE order_dt_txt IS NOT NULL
        AND try_strptime(trim(order_dt_txt), '%Y-%m-%d') IS NULL) FROM orders_txt""")
def evaluate_rules(spark, sf):
    """Rows that break each of a set of rules, on tables with planted defects."""
    named = {n: view(spark, sf, n) for n in ("lineitem_orphan", "orders_sparse", "charges", "orders_txt")}
    named["part"] = table(spark, sf, "part")
    given = [
        ("lineitem_orphan", "not_null", ["l_suppkey"], {}), ("lineitem_orphan", "foreign_key", ["l_partkey"], {"ref_table": "main.part", "ref_column": "p_partkey"}),
        ("lineitem_orphan", "unique_combo", ["l_orderkey", "l_linenumber"], {}), ("charges", "non_negative", ["amount"], {}),
        ("charges", "range", ["amount"], {"min_limit": 0.0, "max_limit": 200000.0}), ("charges", "not_in_future", ["l_shipdate"], {}),
        ("orders_sparse", "filled_when", ["cancel_code"], {"by_column": "o_orderpriority", "when_values": ["5-LOW"]}),
        ("orders_sparse", "in_list", ["cancel_code"], {"allowed": ["C1", "C2"], "nulls_allowed": True}),
        ("orders_sparse", "regex", ["note_txt"], {"regex": "^note [0-9]+$"}), ("orders_txt", "not_empty", ["order_dt_txt"], {}),
        ("orders_txt", "valid_date", ["order_dt_txt"], {"strftime": "%Y-%m-%d"})]
    schema = "schema_name string, table_name string, rule string, columns array<string>, " + ", ".join(f"{k} {t}" for k, t in Q.ARGUMENTS.items())
    rules = spark.createDataFrame([("main", t, r, c, *[a.get(k) for k in Q.ARGUMENTS]) for t, r, c, a in given], schema)
    return Q.evaluate_rules(named, rules).select("table_name", "rule", F.array_join("columns", "+").alias("columns"), "row_count", "failing_rows")


@query("evaluate_suggested", union_sql([
    f"SELECT '{t}' AS table_name, count(*) > 0 AS has_rules, 0::BIGINT AS failing FROM {t}" for t in _INPUT]))
def evaluate_suggested(spark, sf):
    """The suggested rules of criticality `error` hold on the data they were suggested from."""
    named = tables(spark, sf, *_INPUT)
    rules = analyse(named).rules.where("criticality = 'error'")
    return Q.evaluate_rules(named, rules).groupBy("table_name").agg(
        (F.count(F.lit(1)) > 0).alias("has_rules"), F.sum("failing_rows").alias("failing"))


@query("export_dq_rules")
def export_dq_rules(spark, sf):
    """The rules as DQX checks, Great Expectations expectations and Purview rows."""
    rules = _rules(spark, sf, *_INPUT, *_PLANTED)
    part = lambda df, kind, text: df.select(F.lit(kind).alias("kind"), "rule", F.col(text).alias("content"))
    purview = X.export_purview(rules).withColumn("content", F.concat_ws(" | ", "table", "columns", "purview_rule_type", "setting_or_expression"))
    return part(X.export_dqx(rules), "dqx", "check_json").union(part(X.export_gx(rules), "gx", "expectation_json")).union(
        part(purview, "purview", "content"))
