"""When is a column filled? Columns filled together, and columns filled only for some codes of another column."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions.values import filled
from stratalens.operators.graph import connected_components
from stratalens.types import col

# Band of empty share of an optional column (percent), overlap of a group, most values of an explaining
# code, share filled for a code to belong to the rule, precision, coverage, largest share of rows, fewest filled rows.
EMPTY_LOW, EMPTY_HIGH, GROUP_OVERLAP, MAX_CODES = 2, 98, 0.95, 20
CODE_FILLED, PRECISION, COVERAGE, MAX_ROWS_SHARE, MIN_FILLED = 0.5, 0.98, 0.3, 0.9, 20


def filled_flags(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One boolean per column and row: does it hold a real value?"""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[filled(n, types[n]).alias(n) for n in (names or df.columns)])


def optional_columns(infos: list[dict]) -> list[str]:
    found = [i for i in infos if i["effective_null_pct"] is not None
             and EMPTY_LOW <= i["effective_null_pct"] <= EMPTY_HIGH
             and not {"all_null", "constant"} & set(i["flags"]) and i["family"] != "other"]
    return [i["column_name"] for i in found]


def explaining_columns(infos: list[dict]) -> list[str]:
    found = [i for i in infos if i["code_list"] and i["distinct_count"] <= MAX_CODES]
    found.sort(key=lambda i: i["distinct_count"])
    return [i["column_name"] for i in found]


def fill_pairs(df: DataFrame, names: list[str]) -> DataFrame:
    """(left, right, row_count, left_filled, right_filled, both_filled, jaccard) for all pairs of the columns.

    Rows are first counted by which columns they fill, so the pairs are formed from the few fill patterns, not from the
    rows."""
    flags = filled_flags(df, names)
    fills = F.filter(F.array(*[F.when(col(n), F.lit(i)) for i, n in enumerate(names)]), lambda x: x.isNotNull())
    by_fill = flags.groupBy(fills.alias("fills")).agg(F.count(F.lit(1)).alias("n"))
    here = by_fill.select("n", "fills", F.explode("fills").alias("a"))
    both = here.select("n", "a", F.explode("fills").alias("b")).groupBy("a", "b").agg(F.sum("n").alias("both_filled"))
    rows = df.count()
    pairs = df.sparkSession.createDataFrame(
        [(a, b, names[a], names[b], rows) for a, b in itertools.combinations(range(len(names)), 2)],
        "a int, b int, left string, right string, row_count bigint")
    single = both.where("a = b").select("a", F.col("both_filled").alias("filled"))
    joined = (
        pairs.join(both, ["a", "b"], "left")
        .join(single.select("a", F.col("filled").alias("left_filled")), "a", "left")
        .join(single.select(F.col("a").alias("b"), F.col("filled").alias("right_filled")), "b", "left")
        .na.fill(0, ["both_filled", "left_filled", "right_filled"])
    )
    union = F.col("left_filled") + F.col("right_filled") - F.col("both_filled")
    return joined.select("a", "b", "left", "right", "row_count", "left_filled", "right_filled", "both_filled",
                         F.when(union > 0, F.col("both_filled") / union).otherwise(0.0).alias("jaccard"))


def optional_groups(pairs: DataFrame) -> DataFrame:
    """(group_id, columns, filled_rows, row_count, similarity): columns filled on almost the same rows."""
    in_band = (F.col("left_filled") > 0) & (F.col("left_filled") >= EMPTY_LOW / 100 * F.col("row_count")) & (
        F.col("left_filled") <= EMPTY_HIGH / 100 * F.col("row_count"))
    close = pairs.where((F.col("jaccard") >= GROUP_OVERLAP) & in_band)
    groups = connected_components(close, "a", "b")
    left = groups.select(F.col("node").alias("a"), F.col("component").alias("group_id"))
    right = groups.select(F.col("node").alias("b"), F.col("component").alias("other_id"))
    inside = pairs.join(left, "a").join(right, "b").where("group_id = other_id")
    members = F.array_union(F.collect_set(F.struct(F.col("a").alias("p"), F.col("left").alias("c"))),
                            F.collect_set(F.struct(F.col("b").alias("p"), F.col("right").alias("c"))))
    return inside.groupBy("group_id").agg(
        F.transform(F.array_sort(members), lambda m: m["c"]).alias("columns"),
        F.least(F.min("left_filled"), F.min("right_filled")).alias("filled_rows"),
        F.max("row_count").alias("row_count"), F.round(F.min("jaccard"), 4).alias("similarity"))


def fill_by_code(df: DataFrame, names: list[str], explainers: list[str]) -> DataFrame:
    """(column_name, by_column, place, code, row_count, filled_rows) for every optional column and code, in one job."""
    types = {f.name: f.dataType for f in df.schema.fields}
    flags = [filled(n, types[n]).cast("int").alias(f"f{i}") for i, n in enumerate(names)]
    codes = df.select(*flags, *[col(y).cast("string").alias(f"e{j}") for j, y in enumerate(explainers)])
    flag_names = [f"f{i}" for i in range(len(names))]
    long = codes.unpivot(flag_names, [f"e{j}" for j in range(len(explainers))], "by", "code")
    sums = long.groupBy("by", "code").agg(
        F.count(F.lit(1)).alias("row_count"), *[F.sum(f).alias(f) for f in flag_names])
    per_pair = sums.unpivot(["by", "code", "row_count"], flag_names, "flag", "filled_rows")
    place = F.substring("by", 2, 5).cast("int")
    name_of = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)
    named = per_pair.select(
        name_of(names, F.substring("flag", 2, 5).cast("int")).alias("column_name"),
        name_of(explainers, place).alias("by_column"), place.alias("place"), "code", "row_count", "filled_rows")
    return named.where("column_name <> by_column")


def conditional_fill(counts: DataFrame) -> DataFrame:
    """(column_name, by_column, when_values, precision, coverage, filled_rows, rows_when): the best rule per column."""
    in_rule = F.col("filled_rows") / F.col("row_count") >= CODE_FILLED
    per_pair = counts.groupBy("column_name", "by_column", "place").agg(
        F.sum("filled_rows").alias("filled_all"), F.sum("row_count").alias("total"), F.count(F.lit(1)).alias("codes"),
        F.count_if(in_rule).alias("codes_in"),
        F.sum(F.when(in_rule, F.col("row_count")).otherwise(0)).alias("rows_when"),
        F.sum(F.when(in_rule, F.col("filled_rows")).otherwise(0)).alias("filled_when"),
        # at most MAX_CODES values
        F.transform(F.array_sort(F.collect_list(F.when(in_rule, F.struct(F.col("code").isNull().alias("e"), "code")))),
                    lambda x: x["code"]).alias("when_values"))
    precision = F.col("filled_when") / F.nullif(F.col("filled_all"), F.lit(0))
    coverage = F.col("filled_when") / F.nullif(F.col("rows_when"), F.lit(0))
    rules = per_pair.where(
        (F.col("filled_all") >= MIN_FILLED) & (F.col("codes_in") > 0) & (F.col("codes_in") < F.col("codes"))
        & (precision >= PRECISION) & (coverage >= COVERAGE) & (F.col("rows_when") <= MAX_ROWS_SHARE * F.col("total")))
    order = Window.partitionBy("column_name").orderBy(
        F.desc(precision * coverage - 0.01 * F.col("codes_in")), "place")
    return rules.withColumn("rank", F.row_number().over(order)).where("rank = 1").select(
        "column_name", "by_column", "when_values", F.round(precision, 4).alias("precision"),
        F.round(coverage, 4).alias("coverage"), F.col("filled_all").alias("filled_rows"), "rows_when",
        rule_sentence(coverage).alias("sentence"))


def _listed(values: str | Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.coalesce(v, F.lit("(empty)"))), ", ")


def rule_sentence(coverage: Column) -> Column:
    return F.concat(F.col("column_name"), F.lit(" is filled only when "), F.col("by_column"), F.lit(" = "),
                    _listed("when_values"), F.lit(" – in "), F.format_string("%.0f", coverage * 100),
                    F.lit("% of those rows"))


def subtype_view(groups: DataFrame, rules: DataFrame) -> DataFrame:
    """Optional groups; those whose columns all follow the same rule are a possible subtype."""
    each = groups.withColumn("column_name", F.explode("columns")).join(
        rules.select("column_name", "by_column", "when_values"), "column_name", "left")
    same = each.groupBy("group_id").agg(
        F.count("by_column").alias("with_rule"), F.count_distinct("by_column", "when_values").alias("rules"),
        F.max("by_column").alias("by_column"), F.max("when_values").alias("when_values"))
    joined = groups.join(same, "group_id")
    subtype = (F.col("with_rule") == F.size("columns")) & (F.col("rules") == 1)
    filled_pct = F.round(100 * F.col("filled_rows") / F.col("row_count"), 1)
    ending = F.when(subtype, F.concat(F.lit(", only when "), F.col("by_column"), F.lit(" = "), _listed("when_values"),
                                      F.lit(" – a possible subtype"))
                    ).otherwise(F.lit(" – optional attributes of the same kind of row"))
    sentence = F.concat(F.array_join("columns", ", "), F.lit(" are filled together in "),
                        F.regexp_replace(filled_pct.cast("string"), r"\.0$", ""), F.lit("% of rows"), ending)
    return joined.select(
        "columns", "filled_rows", "row_count", "similarity", filled_pct.alias("filled_pct"), subtype.alias("is_subtype"),
        F.when(subtype, F.col("by_column")).alias("by_column"), F.when(subtype, F.col("when_values")).alias("when_values"),
        sentence.alias("sentence"))
