"""Find rows: predicates by type, several tables at once, values anywhere, breakdowns, samples, ad-hoc SQL."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.functions.values import LONG_TEXT, is_real, text_of
from stratalens.operators.privacy import mask_text
from stratalens.operators.profile import Counted
from stratalens.operators.value_freq import Tables, top_per_group, union_all
from stratalens.types import col, family, keyish, split_name

OPERATORS = ["=", "!=", ">", "<", ">=", "<=", "~"]


def parse_values(text: str, op: str) -> list[str]:
    """The values of a lookup; = and != take a comma-separated list."""
    parts = text.split(",") if op in ("=", "!=") else [text]
    return [v for p in parts if (v := p.strip().strip("'\"")) != ""]


def _number(value: str) -> float | int | None:
    try:
        number = float(value)
    except ValueError:
        return None
    return int(number) if number.is_integer() else number


def _period(c: Column, value: str) -> Column | None:
    """A whole day or month as a range on the column, which reaches the Parquet scan."""
    match = re.fullmatch(r"(\d{4})-(\d{2})(?:-(\d{2}))?", value)
    if not match:
        return None
    try:
        start = date(int(match[1]), int(match[2]), int(match[3] or 1))
        end = start + timedelta(days=1) if match[3] else (start + timedelta(days=32)).replace(day=1)
    except (ValueError, OverflowError):
        return None
    return (c >= F.lit(start)) & (c < F.lit(end))


def _compare(c: Column, op: str, value: Column) -> Column:
    return {">": c > value, "<": c < value, ">=": c >= value, "<=": c <= value}[op]


def filter_predicate(df: DataFrame, column: str, op: str, values: list[str]) -> Column:
    """column op value by type family: text ignores case and spaces around, numbers compare as numbers, dates by the
    start of their text form, ~ is "contains"."""
    if op not in OPERATORS:
        raise ValueError(f"op must be one of {OPERATORS}")
    dtype = df.schema[column].dataType
    c, fam = col(column), family(dtype)
    if op == "~":
        # every character stands for itself; the case is ignored
        return F.contains(F.lower(c.cast("string")), F.lit(values[0].lower()))
    equal = op in ("=", "!=")
    if fam == "string":
        test = F.lower(F.trim(c)).isin([v.lower() for v in values]) if equal else _compare(c, op, F.lit(values[0]))
    elif fam == "numeric":
        numbers = [_number(v) for v in values]
        if equal:
            test = c.isin(numbers) if None not in numbers else (
                c.isin([n for n in numbers if n is not None]) | F.lit(None).cast("boolean"))
        else:
            test = _compare(c, op, F.lit(numbers[0]).cast("double" if isinstance(numbers[0], float) else "bigint"))
    elif fam == "temporal":
        if equal:
            test = F.lit(False)
            for v in values:
                period = _period(c, v)
                test = test | (period if period is not None else c.cast("string").startswith(v))
        else:
            moment = "timestamp_ntz" if isinstance(dtype, T.TimestampNTZType) else "timestamp"
            test = _compare(c, op, F.lit(values[0]).try_cast(moment))
    else:
        text = c.cast("string")
        test = F.lower(text).isin([v.lower() for v in values]) if equal else _compare(text, op, F.lit(values[0]))
    return ~test if op == "!=" else test


def _any_column(df: DataFrame, columns: list[str], op: str, values: list[str], masked: dict[str, str], salt: str) -> Column:
    test = F.lit(False)
    for name in columns:
        hidden = masked.get(name) and op in ("=", "!=")
        mine = [mask_text(v, salt, "@" in v) for v in values] if hidden else values
        test = test | F.coalesce(filter_predicate(df, name, op, mine), F.lit(False))
    return test


def multi_table_lookup(tables: Tables, targets: dict[str, list[str]], op: str, text: str, limit: int = 100,
                       masked: dict[str, dict[str, str]] | None = None, salt: str = "") -> tuple[DataFrame, DataFrame]:
    """(counts per table, matching rows as JSON): rows of each table where any of its columns satisfies the predicate.

    targets: columns to test per table. masked: masked columns per table; typed values are masked the same way."""
    values = parse_values(text, op)
    if not values:
        raise ValueError("enter a value")
    counts, rows = [], []
    for name, columns in targets.items():
        df, (schema, table) = tables[name], split_name(name)
        found = df.where(_any_column(df, columns, op, values, (masked or {}).get(name, {}), salt))
        tag = [F.lit(schema).alias("schema_name"), F.lit(table).alias("table_name")]
        counts.append(found.agg(F.count(F.lit(1)).alias("matches")).select(*tag, "matches"))
        rows.append(found.limit(limit).select(*tag, F.to_json(F.struct(*[col(c) for c in df.columns])).alias("row")))
    return union_all(counts), union_all(rows)


def value_search(tables: Tables, value: str, exact: bool = False, examples: int = 3) -> DataFrame:
    """(schema_name, table_name, column_name, hits, examples): which columns contain the value. One scan per table; only
    values that match leave it."""
    text = value.strip()
    number = _number(text.replace(",", ""))
    found = []
    for name, df in tables.items():
        tests = {}
        for f in df.schema.fields:
            c, fam = col(f.name), family(f.dataType)
            if fam == "string":
                low = F.lower(c)
                tests[f.name] = low == text.lower() if exact else F.contains(low, F.lit(text.lower()))
            elif fam == "numeric" and number is not None:
                tests[f.name] = c == F.lit(number)
            elif fam == "temporal" and re.match(r"\d{4}-\d{2}-\d{2}", text):
                tests[f.name] = c.cast("string").startswith(text)
        if not tests:
            continue
        hits = [F.when(test, F.struct(F.lit(n).alias("column_name"), col(n).cast("string").alias("value")))
                for n, test in tests.items()]
        schema, table = split_name(name)
        found.append(df.select(F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("hit")).select(
            F.lit(schema).alias("schema_name"), F.lit(table).alias("table_name"), "hit.*"))
    return _hits(union_all(found).groupBy("schema_name", "table_name", "column_name", "value").agg(
        F.count(F.lit(1)).alias("n")), examples)


def value_search_counted(counted: Counted, value: str, exact: bool = False, examples: int = 3) -> DataFrame:
    """value_search over stored value counts; compares text forms. Counts keep only the start of a long text, so columns that have
    some are read for these rows again, and no other table is."""
    text = value.strip().lower()
    test = F.lower("value") == text if exact else F.contains(F.lower("value"), F.lit(text))
    long = F.coalesce(F.col("text_len") > LONG_TEXT, F.lit(False))
    names = counted.columns.select("col_id", "schema_name", "table_name", "column_name")
    keys = ["schema_name", "table_name", "column_name"]
    found = [counted.freq.where(~long & test).join(F.broadcast(names), "col_id").select(*keys, "value", "n")]
    # at most a row for each column of the catalog
    affected = {r["col_id"] for r in counted.freq.where(long).select("col_id").distinct().collect()}
    for name, df in counted.tables.items():
        schema, table = split_name(name)
        for m in counted.metas:
            if m.col_id in affected and (m.schema_name, m.table_name) == (schema, table):
                whole = df.select(F.expr(text_of(m.column_name, df.schema[m.column_name].dataType)).alias("value")).where(F.length("value") > LONG_TEXT)
                found.append(whole.where(test).groupBy("value").agg(F.count(F.lit(1)).alias("n")).select(
                    F.lit(schema).alias("schema_name"), F.lit(table).alias("table_name"), F.lit(m.column_name).alias("column_name"), "value", "n"))
    return _hits(union_all(found), examples)


def _hits(matches: DataFrame, examples: int) -> DataFrame:
    keys = ["schema_name", "table_name", "column_name"]
    totals = matches.groupBy(*keys).agg(F.sum("n").alias("hits"))
    few = top_per_group(matches, keys, [F.asc("value")], examples).groupBy(*keys).agg(
        F.array_sort(F.collect_list("value")).alias("examples"))
    return totals.join(few, keys)


def breakdown(df: DataFrame, column: str, by: str) -> DataFrame:
    """How a column behaves per value of another: rows, filled rows, distinct values, most common value.

    Counted per (by, value) first: no task holds all values of a group."""
    dtype = df.schema[column].dataType
    counts = df.groupBy(col(by).cast("string").alias("by_value"), col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    is_filled = is_real(F.col("_v"), dtype, keyish(column))
    common = F.when(F.col("_v").isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v")))
    return counts.groupBy("by_value").agg(
        F.sum("_n").alias("row_count"), F.sum(F.when(is_filled, F.col("_n")).otherwise(0)).alias("filled"),
        F.count("_v").alias("distinct_values"), F.min(common)["v"].cast("string").alias("most_common"),
    ).withColumn("filled_pct", F.round(100 * F.col("filled") / F.col("row_count"), 1))


def sample_rows(df: DataFrame, n: int, columns: list[str] | None = None, not_null: list[str] | None = None,
                where: str | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(n repeatable random rows of what matches, number of matching rows). The filter comes before the sampling."""
    matched = df
    for c in not_null or []:
        matched = matched.where(col(c).isNotNull())
    if where:
        matched = matched.where(where)
    plain = [col(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    shuffled = matched.orderBy(F.xxhash64(*plain, F.lit(seed)))          # each task keeps its first n rows
    return shuffled.limit(n).select(*[col(c) for c in columns or df.columns]), matched.agg(F.count(F.lit(1)).alias("matched"))


def adhoc_sql(spark: SparkSession, tables: Tables, query: str, limit: int = 1000) -> DataFrame:
    """A query over the tables by name, cut at `limit` rows; `truncated` tells whether there were more."""
    for name, df in tables.items():
        df.createOrReplaceTempView(split_name(name)[1])
    shown = spark.sql(query).limit(limit + 1)
    everything = Window.partitionBy(F.lit(1))        # at most limit + 1 rows
    counted = shown.withColumn("truncated", F.count(F.lit(1)).over(everything) > limit)
    return counted.limit(limit)
