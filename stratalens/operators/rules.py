"""Data-quality rules suggested from what was found, and their evaluation on the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.functions import values as V
from stratalens.operators.value_freq import Tables, union_all
from stratalens.types import KEYISH_NAME, col, split_name

# Longest code list checked by value; share of one shape; confidence and overlap of a reference; coverage
# of a conditional rule; smallest number of values and greatest length for a shape rule.
IN_LIST_MAX, SHAPE_SHARE, FK_CONFIDENCE, FK_OVERLAP, FILLED_COVERAGE, SHAPE_DISTINCT, SHAPE_LENGTH = (
    50, 0.99, 0.8, 95, 0.95, 20, 40)
# Words of amount columns, and names of dates that lie in the past.
AMOUNT_WORDS = ["amount", "amt", "revenue", "price", "cost", "qty", "quantity", "balance", "points", "rate", "fee", "total",
                "nights", "count", "size", "sqm", "occupancy", "adults", "children", "value", "tax", "discount"]
PAST_DATE_NAME = (r"(?i)birth|dob|created|modified|updated|posted|posting|insert|load|enrol|consent|opening|cancel")
# How Purview names each kind of rule.
PURVIEW_TYPES = {
    "not_null": "Empty/blank fields", "not_empty": "Empty/blank fields", "unique": "Unique values",
    "unique_combo": "Duplicate rows", "in_list": "Custom (SQL expression)", "regex": "String format match",
    "non_negative": "Custom (SQL expression)", "range": "Custom (SQL expression)",
    "not_in_future": "Custom (SQL expression)", "valid_date": "Data type match", "foreign_key": "Table lookup",
    "filled_when": "Custom (SQL expression)",
}

ARGUMENTS = {
    "allowed": "array<string>", "nulls_allowed": "boolean", "regex": "string", "min_limit": "double",
    "max_limit": "double", "date_format": "string", "strftime": "string", "ref_table": "string",
    "ref_column": "string", "by_column": "string", "when_values": "array<string>",
}


def _rule(df: DataFrame, rule: str, columns: Column, criticality: Column, reason: Column, passing: Column | None = None,
          **arguments: Column) -> DataFrame:
    args = [arguments.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in ARGUMENTS.items()]
    rate = F.lit(None) if passing is None else F.round(passing, 2)
    return df.select(
        "schema_name", "table_name", F.lit(rule).alias("rule"), columns.alias("columns"), criticality.alias("criticality"),
        reason.alias("reason"), rate.cast("double").alias("passing_pct"), *args)


def _amount_like(name: Column) -> Column:
    words = F.split(F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", "_")), "_")
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in AMOUNT_WORDS]))


def _percent(share: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", share)


def column_rules(profiled: DataFrame, codes: DataFrame, times: DataFrame) -> DataFrame:
    """Rules about single columns: completeness, allowed values, shape, dates as text, signs, ranges, future dates."""
    error, warn = F.lit("error"), F.lit("warn")
    has = lambda f: F.array_contains("flags", f)
    lists = codes.groupBy("schema_name", "table_name", "column_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "value"))), lambda x: x["value"])
        .alias("list_values"))                  # at most 200 values per code list
    p = profiled.where(~has("all_null")).join(lists, ["schema_name", "table_name", "column_name"], "left")
    name = F.col("column_name")
    own = F.array(name)
    full, text = F.col("null_count") == 0, F.col("family") == "string"
    no_blank = F.coalesce("blank_count", F.lit(0)) == 0
    pii = F.exists("flags", lambda f: f.startswith("pii_"))
    size = F.size("list_values")
    first = F.get("patterns", F.lit(0))
    shape, shape_share = first["shape"], first["n"] / F.col("non_null")
    formats = F.col("date_formats")
    first_format, format_share = F.get(formats, F.lit(0))["format"], F.get(formats, F.lit(0))["share"]
    others = F.array_join(F.transform(F.slice(formats, 2, 20), lambda f: f["format"]), ", ")
    measured = (F.col("family") == "numeric") & ~name.rlike(KEYISH_NAME) & (F.col("non_null") > 0)
    negatives = F.coalesce("negative_count", F.lit(0))
    low = F.when(negatives == 0, F.greatest("outlier_low", F.lit(0.0))).otherwise(F.col("outlier_low"))
    by_share = lambda share: F.when(share >= 1, "error").otherwise("warn")
    shaped = p.where(
        text & (F.size("patterns") > 0) & F.col("list_values").isNull() & (F.col("distinct_count") >= SHAPE_DISTINCT)
        & (F.coalesce("max_len", F.lit(0)) <= SHAPE_LENGTH) & (F.col("non_null") > 0) & ~has("type_hint"))
    dated = p.where(text & F.col("hint_type").isin("DATE", "TIMESTAMP") & (F.size("date_formats") > 0))
    future = times.where((F.col("future_rows") == 0) & name.rlike(PAST_DATE_NAME))
    return union_all([
        _rule(p.where(full & text & no_blank), "not_empty", own, error, F.lit("never empty today")),
        _rule(p.where(full & ~(text & no_blank)), "not_null", own, error, F.lit("never null today")),
        _rule(p.where(F.col("list_values").isNotNull() & (size <= IN_LIST_MAX) & ~pii & ~has("placeholders")), "in_list",
              own, error, F.concat(F.lit("a code list of "), size.cast("string"), F.lit(" values")),
              allowed=F.col("list_values"), nulls_allowed=~full),
        _rule(shaped.where(shape_share >= SHAPE_SHARE), "regex", own, by_share(shape_share),
              F.concat(_percent(100 * shape_share, 1), F.lit("% of values have the shape "), shape),
              100 * shape_share, regex=V.pattern_regex(shape)),
        _rule(dated, "valid_date", own, by_share(format_share),
              F.concat(F.lit("a date stored as text; "), _percent(100 * format_share, 0), F.lit("% use "), first_format,
                       F.when(F.size(formats) > 1, F.concat(F.lit(" (other formats: "), others, F.lit(")"))).otherwise("")),
              100 * format_share * F.col("hint_share"), date_format=V.spark_date_format_col(first_format),
              strftime=first_format),
        _rule(p.where(measured & _amount_like(name) & (negatives == 0)), "non_negative", own, error,
              F.lit("never negative today"), min_limit=F.lit(0.0)),
        _rule(p.where(measured & _amount_like(name) & has("negatives")), "non_negative", own, warn,
              F.concat(F.format_number(negatives, 0), F.lit(" negative values (refunds, reversals or errors?)")),
              100 * (1 - negatives / F.col("non_null")), min_limit=F.lit(0.0)),
        _rule(p.where(measured & (F.col("outlier_count") > 0)), "range", own, warn,
              F.concat(F.format_number("outlier_count", 0), F.lit(" far-out values (beyond 3 × IQR)")),
              100 * (1 - F.col("outlier_count") / F.col("non_null")), min_limit=F.round(low, 2),
              max_limit=F.round("outlier_high", 2)),
        _rule(future, "not_in_future", own, error, F.lit("no future dates today")),
    ])


def suggest_rules(profiled: DataFrame, codes: DataFrame, times: DataFrame, grains: DataFrame, links: DataFrame,
                  fills: DataFrame) -> DataFrame:
    """Every suggested rule with reason and the percentage of rows passing today.

    Rules all rows pass are `error`, rules that describe a problem found are `warn`. Inputs are the results of the other
    operators; fills: conditional_fill rows with schema_name and table_name."""
    rows = profiled.groupBy("schema_name", "table_name").agg(F.max("row_count").alias("row_count"))
    main = grains.where("rank = 1").join(rows, ["schema_name", "table_name"])
    dups = F.col("dup_rows")
    grain_reason = F.concat(F.lit("the grain of the table"), F.when(
        dups > 0, F.concat(F.lit(" – "), F.format_number("dup_rows", 0), F.lit(" duplicate rows today"))).otherwise(""))
    clean = lambda n: F.when(n == 0, "error").otherwise("warn")
    unique = [
        _rule(main.where(test), rule, F.col("combo"), clean(dups), grain_reason, 100 * (1 - dups / F.col("row_count")))
        for rule, test in (("unique", F.size("combo") == 1), ("unique_combo", F.size("combo") > 1))]
    orphans = F.col("orphan_rows")
    sure = links.where((F.col("confidence") >= FK_CONFIDENCE) & (F.col("overlap_pct") >= FK_OVERLAP)).withColumnsRenamed(
        {"from_schema": "schema_name", "from_table": "table_name"}).join(rows, ["schema_name", "table_name"])
    fk_reason = F.concat(F.lit("references "), F.col("to_table"), F.lit("."), F.col("to_column"), F.when(
        orphans > 0, F.concat(F.lit(" – "), F.format_number("orphan_rows", 0), F.lit(" orphan rows today"))).otherwise(""))
    references = _rule(sure, "foreign_key", F.array("from_column"), clean(orphans), fk_reason,
                       100 * (1 - orphans / F.col("row_count")),
                       ref_table=F.concat("to_schema", F.lit("."), "to_table"), ref_column=F.col("to_column"))
    usable = fills.where((F.col("coverage") >= FILLED_COVERAGE) & ~F.exists("when_values", lambda v: v.isNull()))
    filled = _rule(usable, "filled_when", F.array("column_name"), F.lit("warn"), F.col("sentence"),
                   100 * F.col("coverage"), by_column=F.col("by_column"), when_values=F.col("when_values"))
    return union_all([column_rules(profiled, codes, times), *unique, references, filled])


# ---------------------------------------------------------------- evaluation
def _failing(df: DataFrame, r: dict) -> Column | None:
    """True for rows that break a rule which one row alone can break."""
    name = r["columns"][0]
    c, dtype = col(name), df.schema[name].dataType
    text = c.cast("string")
    empty = c.isNull() if not isinstance(dtype, T.StringType) else (c.isNull() | (F.trim(c) == ""))
    rule = r["rule"]
    if rule == "not_null":
        return c.isNull()
    if rule == "not_empty":
        return empty
    if rule == "in_list":
        outside = ~text.isin(r["allowed"])
        return c.isNotNull() & outside if r["nulls_allowed"] else (c.isNull() | outside)
    if rule == "regex":
        return c.isNotNull() & ~text.rlike(r["regex"])
    if rule == "valid_date":
        return c.isNotNull() & F.expr(
            f"{V.parse_any_date(f'trim(CAST({V.quoted(name)} AS STRING))', V.formats_named([r['strftime']]))} IS NULL")
    if rule == "non_negative":
        return c < 0
    if rule == "range":
        return (c < r["min_limit"]) | (c > r["max_limit"])
    if rule == "not_in_future":
        return F.to_date(c.cast("timestamp")) > F.current_date()
    if rule == "filled_when":
        return col(r["by_column"]).cast("string").isin(r["when_values"]) & empty
    return None


RESULT_SCHEMA = ("schema_name string, table_name string, rule string, columns array<string>, row_count bigint, "
                 "failing_rows bigint")


def evaluate_rules(tables: Tables, rules: DataFrame) -> DataFrame:
    """(schema_name, table_name, rule, columns, row_count, failing_rows): one aggregate per table for all rules one row
    can break, a count per key for uniqueness, an anti join for references. The rules (one per finding) are read by the
    driver to build these jobs; the data is not."""
    spark = rules.sparkSession
    wanted = [r.asDict() for r in rules.collect()]
    parts = []
    for name, df in tables.items():
        schema, table = split_name(name)
        mine = [r for r in wanted if (r["schema_name"], r["table_name"]) == (schema, table)]
        row_rules = [(r, test) for r in mine if (test := _failing(df, r)) is not None]
        for start in range(0, len(row_rules), 40):
            chunk = row_rules[start:start + 40]
            one = df.agg(F.count(F.lit(1)).alias("row_count"),
                         *[F.count_if(test).alias(f"f{i}") for i, (_, test) in enumerate(chunk)])
            parts.append(one.select(F.inline(F.array(*[
                _result(r, F.col("row_count"), F.col(f"f{i}")) for i, (r, _) in enumerate(chunk)]))))
        for r in mine:
            if r["rule"] in ("unique", "unique_combo"):
                per_key = df.groupBy(*[col(c) for c in r["columns"]]).agg(F.count(F.lit(1)).alias("_n"))
                whole = F.lit(True)
                for c in r["columns"]:
                    whole = whole & col(c).isNotNull()
                one = per_key.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
                                  F.coalesce(F.sum(F.when(whole, F.col("_n") - 1)), F.lit(0)).alias("f"))
                parts.append(one.select(F.inline(F.array(_result(r, F.col("row_count"), F.col("f"))))))
            elif r["rule"] == "foreign_key" and _table(tables, r["ref_table"]) is not None:
                parts.append(_reference_result(df, _table(tables, r["ref_table"]), r))
    return union_all(parts) if parts else spark.createDataFrame([], RESULT_SCHEMA)


def _table(tables: Tables, name: str) -> DataFrame | None:
    return next((df for n, df in tables.items() if split_name(n) == split_name(name)), None)


def _reference_result(df: DataFrame, parent: DataFrame, r: dict) -> DataFrame:
    """Rows per key first, so that a key on a third of the rows is one row in the join."""
    keys = parent.select(col(r["ref_column"]).cast("string").alias("k")).where("k IS NOT NULL").distinct()
    per_key = df.groupBy(col(r["columns"][0]).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    known = per_key.join(keys.withColumn("known", F.lit(True)), "k", "left")
    orphan = F.col("k").isNotNull() & F.col("known").isNull()
    one = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
                    F.coalesce(F.sum(F.when(orphan, F.col("n"))), F.lit(0)).alias("f"))
    return one.select(F.inline(F.array(_result(r, F.col("row_count"), F.col("f")))))


def _result(r: dict, rows: Column, failing: Column) -> Column:
    return F.struct(
        F.lit(r["schema_name"]).alias("schema_name"), F.lit(r["table_name"]).alias("table_name"),
        F.lit(r["rule"]).alias("rule"), F.array(*[F.lit(c) for c in r["columns"]]).alias("columns"),
        rows.alias("row_count"), failing.alias("failing_rows"))
