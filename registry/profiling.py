"""Column profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registry.core import columns_of, long_sql, query, table, tables, union_sql, view, with_views
from stratalens.functions import values as V
from stratalens.operators import profile as P
from stratalens.operators.grain import key_check
from stratalens.operators.value_freq import Tables, meta_of, value_freq

ALL = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations"]
LONG = long_sql(columns_of(*ALL))
TEXT = long_sql(columns_of(*ALL, kinds="s"))
CUT = "CASE WHEN length({0}) > 200 THEN left({0}, 200) || '…' ELSE {0} END"


def _named(counted: P.Counted, part: DataFrame) -> DataFrame:
    """Results with table and column names instead of ids."""
    return counted.columns.select("col_id", "table_name", "column_name").join(part, "col_id").drop("col_id")


def _counted(spark, sf, keep=True) -> P.Counted:
    return P.count_values(tables(spark, sf, *ALL), keep=keep)


def _planted(spark, sf) -> Tables:
    return {n: view(spark, sf, n) for n in ("orders_txt", "people", "charges", "orders_sparse")}


# ---------------------------------------------------------------- counts and statistics
_COUNTS = union_sql([
    f"""SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count,
        round(100.0 * (count(*) - count({c})) / count(*), 2) AS null_pct, count(DISTINCT {c}) AS distinct_count,
        round(100.0 * count(DISTINCT {c}) / count({c}), 2) AS distinct_pct,
        {CUT.format(f'CAST(min({c}) AS VARCHAR)')} AS min_val, {CUT.format(f'CAST(max({c}) AS VARCHAR)')} AS max_val
        FROM {t}""" for t, c, _ in columns_of(*ALL)])


def _profile_counts(spark, sf):
    counted = _counted(spark, sf)
    sums = P.value_sums(P.value_kinds(counted)).join(P.extremes(counted), "col_id")
    nulls = F.col("row_count") - F.col("non_null")
    return _named(counted, sums).select(
        "table_name", "column_name", "row_count", nulls.alias("null_count"), P.pct(nulls, F.col("row_count")).alias("null_pct"),
        F.col("distinct_values").alias("distinct_count"), P.pct(F.col("distinct_values"), F.col("non_null")).alias("distinct_pct"),
        V.shown(F.col("min_val")).alias("min_val"), V.shown(F.col("max_val")).alias("max_val"))


query("profile_counts", _COUNTS)(_profile_counts)
query("summarize", _COUNTS)(_profile_counts)


@query("profile_strings", union_sql([
    f"""SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) FILTER (WHERE trim({c}) = '') AS blank_count,
        min(length({c})) AS min_len, round(avg(length({c})), 2) AS avg_len, max(length({c})) AS max_len FROM {t}"""
    for t, c, _ in columns_of(*ALL, "pages", kinds="s")]))
def profile_strings(spark, sf):
    named = tables(spark, sf, *ALL, "pages")
    metas = meta_of(named, {t: [c for tt, c, _ in columns_of(*ALL, "pages", kinds="s") if tt == t] for t in named})
    counted = P.count_values(named, metas, keep=False)
    out = _named(counted, P.value_sums(P.value_kinds(counted)))
    return out.select("table_name", "column_name", F.col("blank_n").alias("blank_count"), "min_len", F.round("avg_len", 2).alias("avg_len"), "max_len")


@query("profile_numeric", union_sql([
    f"""SELECT '{t}' AS table_name, '{c}' AS column_name, round(avg(CAST({c} AS DOUBLE)), 4) AS mean,
        round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS stddev, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25,
        round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75
        FROM {t}""" for t, c, _ in columns_of(*ALL, kinds="id")]))
def profile_numeric(spark, sf):
    named = tables(spark, sf, *ALL)
    metas = [m for m in meta_of(named) if m.family == "numeric"]
    counted = P.count_values(named, metas)
    means = P.held(P.value_sums(P.value_kinds(counted)).select("col_id", "mean"))
    stats = means.join(P.deviations(counted, means), "col_id").select(
        "col_id", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"))
    quarts = P.number_quantiles(counted).select("col_id", *[F.round(p, 6).alias(p) for p in ("p25", "p50", "p75")])
    return _named(counted, stats.join(quarts, "col_id"))


@query("profile_temporal", union_sql([
    f"""SELECT '{t}' AS table_name, '{c}' AS column_name, quantile_disc({c}, 0.25) AS p25, quantile_disc({c}, 0.5) AS p50,
        quantile_disc({c}, 0.75) AS p75 FROM {t}""" for t, c, _ in columns_of(*ALL, kinds="t")]))
def profile_temporal(spark, sf):
    named = tables(spark, sf, *ALL)
    counted = P.count_values(named, [m for m in meta_of(named) if m.family == "temporal"])
    quarts = P.moment_quantiles(counted)
    return _named(counted, quarts).select(
        "table_name", "column_name", *[F.col(p).cast("timestamp_ntz").alias(p) for p in ("p25", "p50", "p75")])


@query("approx_distinct", f"""
    SELECT table_name, column_name, count(value) AS non_null,
           CASE WHEN count(DISTINCT value) >= 0.99 * count(value) THEN count(DISTINCT value) END AS exact_if_unique,
           TRUE AS within_bound
    FROM ({LONG}) GROUP BY ALL""")
def approx_distinct(spark, sf):
    """Estimates of all columns, exact counts of nearly unique ones; the estimate must lie within its error bound (here
    four standard errors of the default 5 %)."""
    named = tables(spark, sf, *ALL)
    counted = P.count_values(named)
    exact = counted.freq.groupBy("col_id").agg(F.count(F.lit(1)).alias("d"))
    found = P.approx_distinct(named, counted.metas).join(exact, "col_id")
    bound = F.abs(F.col("approx_distinct") - F.col("d")) <= 0.2 * F.col("d")
    unique = F.col("d") >= 0.99 * F.col("non_null")
    return _named(counted, found).select(
        "table_name", "column_name", "non_null", F.when(unique, F.coalesce("exact_distinct", F.lit(-1))).alias("exact_if_unique"),
        bound.alias("within_bound"))


@query("top_values", f"""
    WITH l AS ({LONG}), g AS (SELECT table_name, column_name, value, count(*) AS n FROM l GROUP BY ALL),
         r AS (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY n DESC, value) AS rank,
                      max(n) OVER (PARTITION BY table_name, column_name) AS most FROM g)
    SELECT table_name, column_name, CAST(rank AS INTEGER) AS rank, n, {CUT.format('value')} AS value
    FROM r WHERE rank <= 10 AND most > 1""")
def top_values(spark, sf):
    counted = _counted(spark, sf, keep=False)
    return _named(counted, P.top_values(counted))


_SHAPE = ("regexp_replace(regexp_replace(regexp_replace(left(value, 40), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), "
          "'[0-9]', '9', 'g')")


@query("patterns", f"""
    WITH l AS ({TEXT}), g AS (SELECT table_name, column_name, {_SHAPE} AS shape, count(*) AS n FROM l GROUP BY ALL),
         r AS (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY n DESC, shape) AS rank FROM g)
    SELECT table_name, column_name, CAST(rank AS INTEGER) AS rank, shape, n FROM r WHERE rank <= 8""")
def patterns(spark, sf):
    named = tables(spark, sf, *ALL)
    counted = P.count_values(named, [m for m in meta_of(named) if m.family == "string"], keep=False)
    return _named(counted, P.patterns(counted))


@query("pii_content", with_views("people") + union_sql([
    f"""SELECT '{t}' AS table_name, '{c}' AS column_name,
        round(avg(CASE WHEN regexp_matches({c}, '{V.EMAIL_VALUE}') THEN 1.0 ELSE 0.0 END), 4) AS email_share,
        round(avg(CASE WHEN regexp_matches({c}, '{V.PHONE_VALUE}') THEN 1.0 ELSE 0.0 END), 4) AS phone_share
        FROM {t} WHERE {c} IS NOT NULL"""
    for t, c in [("people", x) for x in ("first_name", "last_name", "email_address", "mobile_phone", "birth_date", "c_mktsegment")]
    + [("documents", "text"), ("pages", "url")]]))
def pii_content(spark, sf):
    named = {"people": view(spark, sf, "people"), "documents": table(spark, sf, "documents").select("text"),
             "pages": table(spark, sf, "pages").select("url")}
    counted = P.count_values(named, [m for m in meta_of(named) if m.family == "string"], keep=False)
    out = _named(counted, P.value_sums(P.value_kinds(counted)))
    share = lambda c: F.round(F.col(c) / F.col("non_null"), 4)
    return out.select("table_name", "column_name", share("email_rows").alias("email_share"), share("phone_rows").alias("phone_share"))


def _histogram_sql(t: str, c: str, kind: str) -> str:
    x = f"epoch({c})" if kind == "t" else f"CAST({c} AS DOUBLE)"
    return f"""
        SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(bin AS INTEGER) AS bin, round(low + bin * ((high - low) / 20), 4) AS lo,
               round(low + (bin + 1) * ((high - low) / 20), 4) AS hi, coalesce(n, 0) AS n
        FROM (SELECT unnest(range(20)) AS bin, low, high FROM (SELECT min({x}) AS low, max({x}) AS high FROM {t})) f
        LEFT JOIN (SELECT least(floor((x - lo) / (hi - lo) * 20), 19) AS b, count(*) AS n
                   FROM (SELECT {x} AS x, min({x}) OVER () AS lo, max({x}) OVER () AS hi FROM {t} WHERE {c} IS NOT NULL)
                   GROUP BY 1) h ON h.b = f.bin
        WHERE high > low"""


@query("histogram", union_sql([_histogram_sql(*c) for c in columns_of("customer", "orders", "lineitem", "events", kinds="idt")]))
def histogram(spark, sf):
    named = tables(spark, sf, "customer", "orders", "lineitem", "events")
    counted = P.count_values(named, [m for m in meta_of(named) if m.family in ("numeric", "temporal")])
    return _named(counted, P.histograms(counted))


_MEASURES = [("events", "value"), ("charges", "amount"), ("customer", "c_acctbal"), ("lineitem", "l_quantity"),
             ("orders", "o_totalprice"), ("documents", "n_chars")]


def _outlier_sql(t: str, c: str) -> str:
    return f"""
        SELECT '{t}' AS table_name, '{c}' AS column_name, outlier_count, round(lo, 6) AS outlier_low, round(hi, 6) AS outlier_high,
               negative_count, CAST(rank AS INTEGER) AS rank, round(value, 4) AS value, n
        FROM (SELECT min(lo) AS lo, min(hi) AS hi, count(*) FILTER (WHERE v < lo OR v > hi) AS outlier_count,
                     count(*) FILTER (WHERE v < 0) AS negative_count
              FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {t}), fence_{t}) s
        LEFT JOIN (SELECT v AS value, count(*) AS n, row_number() OVER (ORDER BY abs(v - min(mid)) DESC, v) AS rank
                   FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {t}), fence_{t} WHERE v < lo OR v > hi GROUP BY v) e ON rank <= 5"""


@query("outliers", with_views("charges").rstrip() + ", " + ", ".join(
    f"""fence_{t} AS (SELECT q1 - 3.0 * (q3 - q1) AS lo, q3 + 3.0 * (q3 - q1) AS hi, (q1 + q3) / 2 AS mid FROM (
        SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {t}))"""
    for t, c in _MEASURES) + "\n" + union_sql([_outlier_sql(t, c) for t, c in _MEASURES]))
def outliers(spark, sf):
    """Far-out values with the most extreme examples, and negative values."""
    named = {t: (view if t == "charges" else table)(spark, sf, t).select(c) for t, c in _MEASURES}
    counted = P.count_values(named)
    quarts = P.held(P.number_quantiles(counted))
    counts, examples = P.outliers(counted, quarts)
    negatives = P.value_sums(P.value_kinds(counted)).select("col_id", F.col("negatives").alias("negative_count"))
    out = counts.join(negatives, "col_id").join(
        examples.select("col_id", "rank", F.round("value", 4).alias("value"), "n"), "col_id", "left")
    return _named(counted, out)


_PLACEHOLDER_LIST = ", ".join("'" + v + "'" for v in V.PLACEHOLDERS)
_KEY_LIST = _PLACEHOLDER_LIST + ", '0', '-1'"
_PLACE_COLUMNS = [
    ("orders_txt", "order_dt_txt", "s"), ("orders_txt", "closed_on", "t"), ("orders_txt", "agent_id", "k"),
    ("orders_txt", "o_orderkey", "k"), ("orders_sparse", "note_txt", "s"), ("orders_sparse", "o_orderkey", "k"),
]


def _placeholder_sql(t: str, c: str, kind: str) -> str:
    test = {"s": f"upper(trim({c})) IN ({_PLACEHOLDER_LIST})", "t": f"(year({c}) <= 1900 OR year({c}) >= 9999)",
            "k": f"CAST({c} AS DOUBLE) IN (0, -1)"}[kind]
    return f"""
        SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS INTEGER) AS rank,
               CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {t} WHERE {c} IS NOT NULL AND {test} GROUP BY {c}"""


@query("placeholders", with_views("orders_txt", "orders_sparse") + union_sql([_placeholder_sql(*c) for c in _PLACE_COLUMNS]))
def placeholders(spark, sf):
    counted = P.count_values({n: view(spark, sf, n) for n in ("orders_txt", "orders_sparse")})
    return _named(counted, P.placeholders(counted))


@query("effective_nulls", with_views("orders_txt", "orders_sparse") + union_sql([
    f"""SELECT '{t}' AS table_name, '{c}' AS column_name, round(100.0 * count(*) FILTER (WHERE {c} IS NULL OR {blank} OR {test}) / count(*), 2)
        AS effective_null_pct FROM {t}"""
    for t, c, blank, test in [
        ("orders_txt", "order_dt_txt", "trim(order_dt_txt) = ''", f"upper(trim(order_dt_txt)) IN ({_PLACEHOLDER_LIST})"),
        ("orders_txt", "closed_on", "FALSE", "year(closed_on) <= 1900"), ("orders_txt", "agent_id", "FALSE", "agent_id = 0"),
        ("orders_sparse", "note_txt", "FALSE", f"upper(trim(note_txt)) IN ({_PLACEHOLDER_LIST})"),
        ("orders_sparse", "cancel_code", "FALSE", "FALSE")]]))
def effective_nulls(spark, sf):
    """Nulls, blanks and placeholders together."""
    p = P.profile({n: view(spark, sf, n) for n in ("orders_txt", "orders_sparse")})
    wanted = ["order_dt_txt", "closed_on", "agent_id", "note_txt", "cancel_code"]
    return p.where(F.col("column_name").isin(wanted)).select("table_name", "column_name", "effective_null_pct")


_HINT_COLUMNS = ["order_dt_txt", "amount_txt", "zip_txt", "flag_txt", "rate_txt", "o_orderstatus"]


def _hint_sql(c: str) -> str:
    ph = f"upper(trim({c})) IN ({_PLACEHOLDER_LIST})"
    return f"""
        SELECT '{c}' AS column_name, CASE
            WHEN trim({c}) = '' OR {ph} THEN NULL
            WHEN regexp_full_match(trim({c}), '[+-]?[0-9]+') THEN 'int'
            WHEN regexp_full_match(trim({c}), '[+-]?([0-9]+[.][0-9]*|[.][0-9]+)') THEN 'decimal'
            WHEN upper(trim({c})) IN ('Y', 'N', 'YES', 'NO', 'TRUE', 'FALSE', 'T', 'F') THEN 'bool'
            WHEN try_strptime(trim({c}), '%Y-%m-%d') IS NOT NULL THEN '%Y-%m-%d'
            WHEN try_strptime(trim({c}), '%d/%m/%Y') IS NOT NULL THEN '%d/%m/%Y' ELSE 'text' END AS k,
            regexp_full_match(trim({c}), '0[0-9]+') AS zero
        FROM orders_txt WHERE {c} IS NOT NULL"""


@query("type_hint", with_views("orders_txt").rstrip() + f""",
    k AS ({union_sql([_hint_sql(c) for c in _HINT_COLUMNS])}),
    s AS (SELECT column_name, count(k) AS checked, count(*) FILTER (WHERE k = 'int') AS i, count(*) FILTER (WHERE k = 'decimal') AS d,
                 count(*) FILTER (WHERE k = 'bool') AS b, count(DISTINCT k) AS kinds, count(*) FILTER (WHERE k LIKE '\\%%' ESCAPE '\\') AS dt,
                 count(*) FILTER (WHERE k = '%Y-%m-%d') AS iso, count(*) FILTER (WHERE k = '%d/%m/%Y') AS dmy,
                 count(*) FILTER (WHERE zero) AS zeros FROM k GROUP BY 1),
    h AS (SELECT *, CASE WHEN i > 0 THEN zeros ELSE 0 END AS leading_zero_count FROM s)
    SELECT column_name, checked, leading_zero_count,
           CASE WHEN i / checked >= 0.95 AND leading_zero_count = 0 THEN 'BIGINT'
                WHEN (i + d) / checked >= 0.95 AND d > 0 AND leading_zero_count = 0 THEN 'DECIMAL'
                WHEN b / checked >= 0.95 AND kinds = 1 THEN 'BOOLEAN' WHEN dt > 0 AND dt / checked >= 0.95 THEN 'DATE' END AS hint_type,
           CASE WHEN i / checked >= 0.95 AND leading_zero_count = 0 THEN round(i / checked, 4)
                WHEN (i + d) / checked >= 0.95 AND d > 0 AND leading_zero_count = 0 THEN round((i + d) / checked, 4)
                WHEN b / checked >= 0.95 AND kinds = 1 THEN round(b / checked, 4)
                WHEN dt > 0 AND dt / checked >= 0.95 THEN round(dt / checked, 4) END AS hint_share,
           CASE WHEN dt > 0 AND dt / checked >= 0.95 THEN '%Y-%m-%d=' || CAST(round(iso / dt, 4) AS VARCHAR) || ',%d/%m/%Y=' ||
                CAST(round(dmy / dt, 4) AS VARCHAR) WHEN b / checked >= 0.95 OR (i + d) / checked >= 0.95 AND leading_zero_count = 0 THEN '' END AS formats
    FROM h""")
def type_hint(spark, sf):
    """What text columns would parse as, with the shares of the date formats and the leading zeros that forbid it."""
    named = {"orders_txt": view(spark, sf, "orders_txt").select(*_HINT_COLUMNS)}
    counted = P.count_values(named, keep=False)
    hints = P.type_hints(P.value_kinds(counted))
    text = F.array_join(F.transform("date_formats", lambda f: F.concat(f["format"], F.lit("="), f["share"].cast("string"))), ",")
    return _named(counted, hints).select("column_name", "checked", "leading_zero_count", "hint_type", "hint_share", text.alias("formats"))


# ---------------------------------------------------------------- flags
_FLAG_TABLES = ["customer", "nation", "orders", "conversations"]


def _flag_sql(t: str, c: str, kind: str) -> str:
    """Flags that follow from counts; the columns of these tables have no others."""
    key = "TRUE" if kind in "is" else "FALSE"
    is_key_name = f"regexp_matches('{c}', '(_?(id|key|code|no|num|nbr|number|cd|ref))$', 'i')"
    num = f"CAST({c} AS DOUBLE)" if kind in "id" else "CAST(NULL AS DOUBLE)"
    holder = (f"upper(trim({c})) IN ({_PLACEHOLDER_LIST})" if kind == "s" else
              f"({is_key_name} AND {num} IN (0, -1))" if kind in "id" else f"(year({c}) <= 1900 OR year({c}) >= 9999)")
    text = f"CAST({c} AS VARCHAR)" if kind == "s" else "NULL"
    return f"""
        SELECT '{t}' AS table_name, '{c}' AS column_name, unnest(list_filter([
            CASE WHEN d = 1 THEN 'constant' END, CASE WHEN d = n AND {key} THEN 'candidate_pk' END,
            CASE WHEN d = n AND NOT {key} THEN 'unique' END,
            CASE WHEN shapes > 1 AND d > 1 AND same / n < 0.8 THEN 'mixed_format' END,
            CASE WHEN ph > 0 THEN 'placeholders' END,
            CASE WHEN hinted >= 0.95 THEN 'type_hint' END,
            CASE WHEN NOT {is_key_name} AND q3 > q1 AND (low < q1 - 3 * (q3 - q1) OR high > q3 + 3 * (q3 - q1)) THEN 'outliers' END,
            CASE WHEN NOT {is_key_name} AND neg > 0 AND neg <= 0.05 * n THEN 'negatives' END], lambda x: x IS NOT NULL)) AS flag
        FROM (SELECT count({c}) AS n, count(DISTINCT {c}) AS d, count(*) FILTER (WHERE {holder}) AS ph,
                     quantile_cont({num}, 0.25) AS q1, quantile_cont({num}, 0.75) AS q3, min({num}) AS low, max({num}) AS high,
                     count(*) FILTER (WHERE {num} < 0) AS neg,
                     coalesce(avg(CASE WHEN upper(trim({text})) IN ('Y', 'N', 'YES', 'NO', 'TRUE', 'FALSE', 'T', 'F') THEN 1.0 ELSE 0.0 END)
                              FILTER (WHERE {text} IS NOT NULL), 0) AS hinted FROM {t}),
             (SELECT sum(shapes) AS shapes, max(n) AS same FROM (
                 SELECT regexp_replace(regexp_replace(regexp_replace(p, 'A+', 'A', 'g'), 'a+', 'a', 'g'), '9+', '9', 'g') AS s,
                        count(*) AS shapes, sum(n) AS n
                 FROM (SELECT {_SHAPE} AS p, count(*) AS n FROM (SELECT {text} AS value FROM {t}) WHERE value IS NOT NULL
                       GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8) GROUP BY 1))"""


@query("profile_flags", union_sql([_flag_sql(*c) for c in columns_of(*_FLAG_TABLES)]))
def profile_flags(spark, sf):
    p = P.profile(tables(spark, sf, *_FLAG_TABLES))
    return p.select("table_name", "column_name", F.explode("flags").alias("flag"))


@query("candidate_keys", union_sql([
    f"SELECT '{t}' AS table_name, '{c}' AS column_name FROM {t} HAVING count(DISTINCT {c}) = count(*) AND count(*) > 0"
    for t, c, _ in columns_of(*ALL, kinds="is")]))
def candidate_keys(spark, sf):
    return P.candidate_keys(P.profile(tables(spark, sf, *ALL))).select("table_name", "column_name")


@query("whole_table_profile", union_sql([
    f"""SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count,
        CASE WHEN count(DISTINCT {c}) >= 0.99 * count(*) THEN count(DISTINCT {c}) END AS exact_if_unique,
        CAST(min({c}) AS VARCHAR) AS min_val, CAST(max({c}) AS VARCHAR) AS max_val FROM {t}"""
    for t, c, _ in columns_of("orders", "lineitem", "customer", kinds="idt")]))
def whole_table_profile(spark, sf):
    """Details from a sample of the larger tables, counts of the whole tables."""
    p = P.whole_table_profile(tables(spark, sf, "orders", "lineitem", "customer"), sample_rows=5000)
    unique = F.col("distinct_count") >= 0.99 * F.col("row_count")
    return p.where(F.col("family") != "string").select(
        "table_name", "column_name", "row_count", "null_count", F.when(unique, F.col("distinct_count")).alias("exact_if_unique"),
        "min_val", "max_val")


@query("precision_overflow", """
    SELECT 'l_extendedprice' AS column_name, 'decimal(10,6)' AS declared_type, round(max(abs(l_extendedprice)), 4) AS max_abs
    FROM lineitem HAVING max(abs(l_extendedprice)) >= 10000
    UNION ALL SELECT 'l_discount', 'decimal(3,2)', round(max(abs(l_discount)), 4) FROM lineitem HAVING max(abs(l_discount)) >= 10""")
def precision_overflow(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").cast("decimal(38,6)").alias("l_extendedprice"), F.col("l_discount").cast("decimal(38,2)").alias("l_discount"))
    declared = {"l_extendedprice": T.DecimalType(10, 6), "l_discount": T.DecimalType(3, 2)}
    return P.precision_overflow(df, declared).withColumn("max_abs", F.round("max_abs", 4))


@query("resilient_profile", """
    SELECT 'events' AS table_name, 'event_id' AS column_name, count(*) AS row_count, count(DISTINCT event_id) AS distinct_count FROM events
    UNION ALL SELECT 'events', 'parsed', count(*), count(DISTINCT props) FROM events
    UNION ALL SELECT 'events', 'attributes', count(*), count(DISTINCT props) FROM events""")
def resilient_profile(spark, sf):
    """Nested and odd columns are profiled as text and lose nothing else."""
    df = table(spark, sf, "events").select(
        "event_id", F.from_json("props", "k bigint").alias("parsed"), F.from_json("props", "map<string,string>").alias("attributes"))
    return P.resilient_profile({"events": df}).select("table_name", "column_name", "row_count", "distinct_count")


@query("key_check", """
    SELECT 'l_orderkey+l_partkey' AS columns, count(*) AS rows, count(DISTINCT (l_orderkey, l_partkey)) AS distinct_rows,
           0::BIGINT AS rows_with_nulls, count(*) = count(DISTINCT (l_orderkey, l_partkey)) AS is_unique, 'summary' AS part,
           CAST(NULL AS VARCHAR) AS combination, CAST(NULL AS BIGINT) AS n FROM lineitem
    UNION ALL
    SELECT 'l_orderkey+l_partkey', NULL, NULL, NULL, NULL, 'example', combination, n FROM (
      SELECT l_orderkey || ' ' || l_partkey AS combination, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey
      HAVING count(*) > 1 ORDER BY n DESC, l_orderkey, l_partkey LIMIT 10)""")
def check_key(spark, sf):
    summary, examples = key_check(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])
    named = summary.select(F.lit("l_orderkey+l_partkey").alias("columns"), "*", F.lit("summary").alias("part"))
    shown = examples.select(F.lit("l_orderkey+l_partkey").alias("columns"), F.lit("example").alias("part"),
                            F.concat_ws(" ", "l_orderkey", "l_partkey").alias("combination"), "n")
    return named.unionByName(shown, allowMissingColumns=True)


@query("key_fingerprints", union_sql([
    f"""SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, TRUE AS complete FROM {t}
        WHERE {c} IS NOT NULL GROUP BY {c}""" for t, c in [
            ("nation", "n_nationkey"), ("nation", "n_name"), ("nation", "n_regionkey"), ("customer", "c_custkey"), ("customer", "c_name"),
            ("customer", "c_nationkey"), ("orders", "o_orderkey"), ("orders", "o_custkey")]]))
def key_fingerprints(spark, sf):
    named = tables(spark, sf, "nation", "customer", "orders")
    counted = P.count_values(named)
    found = P.key_fingerprints(counted, P.profile(named, counted=counted))
    return _named(counted, found)


@query("column_profile")
def column_profile(spark, sf):
    """The whole profile, one row per column with nested lists."""
    return P.profile({**tables(spark, sf, *ALL), **_planted(spark, sf)})


@query("value_freq", f"SELECT table_name, column_name, {CUT.format('value')} AS value, CAST(sum(n) AS BIGINT) AS n FROM ("
                     f"SELECT table_name, column_name, value, count(*) AS n FROM ({LONG}) WHERE value IS NOT NULL GROUP BY ALL) "
                     f"GROUP BY 1, 2, 3")
def all_value_counts(spark, sf):
    named = tables(spark, sf, *ALL)
    counted = P.Counted(spark, named, meta_of(named), value_freq(named, by_text=True))
    named = _named(counted, counted.freq.select("col_id", "value", "n"))
    return named.groupBy("table_name", "column_name", V.shown(F.col("value")).alias("value")).agg(F.sum("n").alias("n"))
