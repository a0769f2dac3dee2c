"""Which months each date column covers, with gaps, future rows and sentinel dates, and which date is the primary one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import values as V
from stratalens.types import col

# Names that suggest the primary date, most telling first.
PRIMARY_DATE_NAMES = ["business_date", "posting", "arrival", "transaction", "txn", "order", "booking", "stay", "sale",
                      "invoice", "event", "created", "date"]
# A stamp spans at most so many months and has at least so many rows; an event has so many distinct
# values and rows in its median month; series with more points than this are given by year.
STAMP_MONTHS, STAMP_ROWS, EVENT_DISTINCT, EVENT_MEDIAN, MAX_POINTS = 2, 100, 24, 10, 240


def moment_of(info: dict) -> Column | None:
    """A timestamp for date columns and for text columns that hold dates."""
    c = col(info["column_name"])
    if info["family"] == "temporal":
        return c.cast("timestamp")
    if info["family"] == "string" and info["hint_type"] in ("DATE", "TIMESTAMP"):
        formats = V.formats_named([f["format"] for f in info["date_formats"] or []])
        return F.expr(V.parse_any_date(f"trim({V.quoted(info['column_name'])})", formats))
    return None


def monthly_rows(df: DataFrame, infos: list[dict]) -> DataFrame | None:
    """(column_name, month, n, future_n): rows per month; month is null for sentinel dates."""
    dated = [(i["column_name"], m) for i in infos if (m := moment_of(i)) is not None]
    if not dated:
        return None
    long = df.select(*[m.alias(name) for name, m in dated]).unpivot([], [col(n) for n, _ in dated], "column_name", "at")
    at = F.col("at")
    month = F.when(~V.is_sentinel_year(at), F.to_date(F.date_trunc("month", at)))
    future = ~V.is_sentinel_year(at) & (F.to_date(at) > F.current_date())
    return long.where(at.isNotNull()).groupBy("column_name", month.alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(future).alias("future_n"))


TIME_SCHEMA = (
    "schema_name string, table_name string, column_name string, parsed_from_text boolean, first_month date, "
    "last_month date, months_present bigint, empty_months bigint, future_rows bigint, sentinel_rows bigint, "
    "dated_rows bigint, kind string, is_primary boolean, series_grain string, "
    "series array<struct<point:string,n:bigint>>")


def time_coverage(df: DataFrame, infos: list[dict], schema: str, table: str) -> DataFrame:
    """One row per date column with at least one real date."""
    spark = df.sparkSession
    monthly = monthly_rows(df, infos)
    if monthly is None:
        return spark.createDataFrame([], TIME_SCHEMA)
    facts = spark.createDataFrame(
        [(i["column_name"], i["family"] == "string", i["data_type"].startswith("timestamp"), i["distinct_count"],
          i["ordinal"]) for i in infos],
        "column_name string, parsed_from_text boolean, is_timestamp boolean, distinct_count bigint, ordinal int")
    real = F.col("month").isNotNull()
    counts = F.array_sort(F.collect_list(F.when(real, F.col("n"))))     # one entry per month
    covered = monthly.groupBy("column_name").agg(
        F.min("month").alias("first_month"), F.max("month").alias("last_month"),
        F.count("month").alias("months_present"), F.sum("future_n").alias("future_rows"),
        F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("sentinel_rows"),
        F.sum(F.when(real, F.col("n"))).alias("dated_rows"),
        F.element_at(counts, (F.floor(F.count("month") / 2) + 1).cast("int")).alias("median_month"),
        F.array_sort(F.collect_list(F.when(real, F.struct(
            F.date_format("month", "yyyy-MM").alias("point"), F.col("n").alias("n"))))).alias("by_month"),
    ).where("dated_rows > 0")
    yearly = monthly.where(real).groupBy("column_name", F.date_format("month", "yyyy").alias("point")).agg(
        F.sum("n").alias("n")).groupBy("column_name").agg(
        F.array_sort(F.collect_list(F.struct("point", "n"))).alias("by_year"))
    span = (F.year("last_month") - F.year("first_month")) * 12 + F.month("last_month") - F.month("first_month") + 1
    kind = (
        F.when((F.col("months_present") <= STAMP_MONTHS) & (F.col("dated_rows") >= STAMP_ROWS) & F.col("is_timestamp"),
               F.lit("stamp"))
        .when((F.col("distinct_count") >= EVENT_DISTINCT) & (F.col("median_month") >= EVENT_MEDIAN), F.lit("event"))
        .otherwise(F.lit("attribute")))
    told = F.lit(0)
    for place, word in reversed(list(enumerate(PRIMARY_DATE_NAMES))):
        told = F.when(F.lower("column_name").contains(word), F.lit(len(PRIMARY_DATE_NAMES) - place)).otherwise(told)
    best = Window.partitionBy("kind").orderBy(F.desc("told"), F.desc("months_present"), F.desc("dated_rows"), "ordinal")
    by_year = F.col("months_present") > MAX_POINTS
    return (
        covered.join(facts, "column_name").join(yearly, "column_name")
        .withColumn("kind", kind).withColumn("told", told)
        .withColumn("is_primary", (F.col("kind") == "event") & (F.row_number().over(best) == 1))
        .select(
            F.lit(schema).alias("schema_name"), F.lit(table).alias("table_name"), "column_name", "parsed_from_text",
            "first_month", "last_month", "months_present",
            (span - F.col("months_present")).cast("bigint").alias("empty_months"), "future_rows", "sentinel_rows",
            "dated_rows", "kind", "is_primary",
            F.when(by_year, F.lit("year")).otherwise(F.lit("month")).alias("series_grain"),
            F.when(by_year, F.col("by_year")).otherwise(F.col("by_month")).alias("series"))
    )
