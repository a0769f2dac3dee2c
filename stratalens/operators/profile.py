"""Column profiles: counts, text and number statistics, frequent values, shapes, disguised nulls, type hints,
histograms, outliers, flags and candidate keys.

Each table is read once, to count its values (`value_freq`); everything else is computed from the counts, whose size is
that of the distinct values. What a profile keeps is a few rows per column, so those are small local results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.functions import values as V
from stratalens.operators.quantiles import quantiles
from stratalens.operators.value_freq import Tables, top_per_group, union_all, value_freq
from stratalens.staging import held, small_tasks, stage, stage_parts, together
from stratalens.types import (
    KEYISH_NAME, PII_NAME, ColumnMeta, col, column_frame, column_list, dateish, keyish, pct, split_name,
)

# How many frequent values and shapes are kept, histogram bins, examples of odd values.
TOP_VALUES, TOP_SHAPES, BINS, EXAMPLES = 10, 8, 20, 5
# Share of values that must parse before a type is hinted; fence distance in interquartile ranges.
HINT_SHARE, FENCE = 0.95, 3.0
# Shares behind the flags.
PII_SHARE, ONE_FORMAT_SHARE, HIGH_NULL_PCT, FEW_NEGATIVES = 0.8, 0.8, 50, 0.05
SKETCH_BITS = 14        # of distinct-count sketches: standard error below 1 %


def whole_counts(tables: Tables, metas: list[ColumnMeta], fences: dict[int, tuple[float, float]] | None = None) -> DataFrame:
    """(col_id, row_count, non_null, blank_count, min_val, max_val, approx_distinct): one aggregate per table, combined in
    the map tasks, for tables too big to count every value of. Only sketches and extremes leave a task.

    fences: of numeric columns by col_id; if given, also negative_count, placeholder_count and outlier_count."""
    views, parts = {}, []
    for i, (name, df) in enumerate(tables.items()):
        types = {f.name: f.dataType for f in df.schema.fields}
        rows = []
        for m in metas:
            if (m.schema_name, m.table_name) != split_name(name):
                continue
            c = V.quoted(m.column_name) if m.family != "other" else V.text_of(m.column_name, types[m.column_name])
            blank = f"count_if(trim({c}) = '')" if m.family == "string" else "CAST(NULL AS bigint)"
            odd = "" if fences is None else _odd_counts(m, c, fences.get(m.col_id))
            rows.append(f"""struct({m.col_id} AS col_id, count(1) AS row_count, count({c}) AS non_null, {blank} AS blank_count,
                CAST(min({c}) AS string) AS min_val, CAST(max({c}) AS string) AS max_val,
                hll_sketch_estimate(hll_sketch_agg(CAST({c} AS string), {SKETCH_BITS})) AS approx_distinct{odd})""")
        if rows:
            views[f"t{i}"] = df
            parts.append(f"SELECT inline(r) FROM (SELECT array({', '.join(rows)}) AS r FROM {{t{i}}})")
    return next(iter(tables.values())).sparkSession.sql(" UNION ALL ".join(parts), **views)


def _odd_counts(m: ColumnMeta, c: str, fence: tuple[float, float] | None) -> str:
    """SQL for a column's negative, placeholder and outlier rows, by the tests of value_kinds and outliers."""
    number, key_like, tests = f"CAST({c} AS double)", keyish(m.column_name), ["false"] * 3
    if m.family == "string":
        tests[1] = V.placeholder_test(f"trim({c})", key_like)
    elif m.family == "temporal":
        tests[1] = f"year(CAST({c} AS timestamp)) <= 1900 OR year(CAST({c} AS timestamp)) >= 9999"
    elif m.family == "numeric":
        tests[0] = f"{number} < 0"
        tests[1] = f"{number} IN (0.0D, -1.0D)" if key_like else "false"
        tests[2] = "false" if fence is None else " OR ".join(f"{number} {side} CAST('{x!r}' AS double)" for side, x in zip("<>", fence))
    return "".join(f", count_if({test}) AS {kind}_count" for kind, test in zip(("negative", "placeholder", "outlier"), tests))


@dataclass
class Counted:
    """Tables with their column metadata and value counts (nulls included): the input of every value-based operator."""

    spark: SparkSession
    tables: Tables
    metas: list[ColumnMeta]
    counts: DataFrame | None

    @property
    def freq(self) -> DataFrame:
        return self.counts.where(F.col("value").isNotNull())

    @property
    def columns(self) -> DataFrame:
        return column_frame(self.spark, self.metas)

    def ids(self, *families: str) -> list[int]:
        return [m.col_id for m in self.metas if m.family in families]

    def of(self, *families: str) -> DataFrame:
        return self.freq.where(F.col("family").isin(*families))

    def key_like_ids(self) -> list[int]:
        return [m.col_id for m in self.metas if keyish(m.column_name)]

    def date_like_ids(self) -> list[int]:
        return [m.col_id for m in self.metas if dateish(m.column_name)]


@small_tasks
def count_values(tables: Tables, metas: list[ColumnMeta] | None = None, keep: bool = True) -> Counted:
    """Value counts of the tables' columns; keep=True writes them once for the jobs that read them again."""
    metas = column_list(tables) if metas is None else metas
    spark = next(iter(tables.values())).sparkSession
    if not keep:
        return Counted(spark, tables, metas, value_freq(tables, metas))
    # one job for each family, written as it comes: a single job would sort all counts of a task by family first
    families = {f: [m for m in metas if m.family == f] for f in dict.fromkeys(m.family for m in metas)}
    frames = {f: value_freq(tables, same) for f, same in families.items()}
    return Counted(spark, tables, metas, stage_parts(frames, "value_freq", "family"))


# ---------------------------------------------------------------- from value counts
def top_values(counted: Counted, top_n: int = TOP_VALUES) -> DataFrame:
    """(col_id, rank, value, n): most frequent values, ties by value; columns without repeats have none."""
    ranked = top_per_group(counted.freq, ["col_id"], [F.desc("n"), F.asc("value")], top_n)
    # the most frequent value occurs once: every value does
    repeats = F.max("n").over(Window.partitionBy("col_id")) > 1
    return ranked.withColumn("repeats", repeats).where("repeats").select(
        "col_id", "rank", V.shown(F.col("value")).alias("value"), "n")


def patterns(counted: Counted, keep: int = TOP_SHAPES) -> DataFrame:
    """(col_id, rank, shape, n): most frequent character shapes of text columns."""
    shapes = (
        counted.of("string").groupBy("col_id", V.shape(F.col("value")).alias("shape")).agg(F.sum("n").alias("n"))
    )
    return top_per_group(shapes, ["col_id"], [F.desc("n"), F.asc("shape")], keep).select("col_id", "rank", "shape", "n")


def _placeholder_test(counted: Counted) -> Column:
    fam, key_like = F.col("family"), F.col("col_id").isin(counted.key_like_ids())
    return (
        F.when(fam == "string", V.is_placeholder(F.col("trimmed"), key_like))
        .when(fam == "temporal", V.is_sentinel_year(F.timestamp_micros("whole")))
        .when((fam == "numeric") & key_like, F.col("num").isin(0.0, -1.0))
        .otherwise(F.lit(False))
    )


def placeholders(counted: Counted, keep: int = EXAMPLES) -> DataFrame:
    """(col_id, rank, value, n): the most frequent values that stand for "no value"."""
    found = counted.of("string", "temporal", "numeric").where(_placeholder_test(counted))
    return top_per_group(found, ["col_id"], [F.desc("n"), F.asc("value")], keep).select("col_id", "rank", "value", "n")


def value_kinds(counted: Counted) -> DataFrame:
    """One row per column and kind of value, each distinct value looked at once. kind is what the real values of text
    columns would parse as, null for everything else; the sums are weighted by rows."""
    n, num, trimmed = F.col("n"), F.col("num"), F.col("trimmed")
    there, text = F.col("value").isNotNull(), F.col("family") == "string"
    odd = there & _placeholder_test(counted)
    kind = F.when(there & text & (trimmed != "") & ~odd,
                  V.value_kind("trimmed", F.col("col_id").isin(counted.date_like_ids())))
    rows_of = lambda test: F.sum(F.when(test, n).otherwise(0))
    length = F.when(text, F.col("text_len")).cast("bigint")
    return counted.counts.groupBy("col_id", kind.alias("kind")).agg(
        F.sum("n").alias("n"), rows_of(~there).alias("null_n"), F.count("value").alias("distinct_values"),
        F.max(F.when(there, n)).alias("most"), rows_of(odd).alias("placeholder_n"),
        rows_of(text & trimmed.rlike(r"^0[0-9]+$")).alias("zeros"), rows_of(text & (trimmed == "")).alias("blank_n"),
        F.min(length).alias("min_len"), F.max(length).alias("max_len"), F.sum(length * n).alias("sum_len"),
        rows_of(text & F.col("is_email")).alias("email_n"), rows_of(text & F.col("is_phone")).alias("phone_n"),
        F.sum(num * n).alias("sum_num"), F.min("num").alias("min_num"), F.max("num").alias("max_num"),
        F.min("whole").alias("min_whole"), F.max("whole").alias("max_whole"), rows_of(num < 0).alias("negative_n"))


def value_sums(kinds: DataFrame) -> DataFrame:
    """One row per column from value_kinds: counts, lengths, mean, extremes."""
    total = lambda c: F.sum(c).alias(c)
    summed = kinds.groupBy("col_id").agg(
        F.sum("n").alias("row_count"), *[total(c) for c in ("null_n", "distinct_values", "placeholder_n", "blank_n", "email_n",
                                                            "phone_n", "sum_len", "sum_num", "negative_n")],
        *[F.min(c).alias(c) for c in ("min_len", "min_num", "min_whole")],
        *[F.max(c).alias(c) for c in ("most", "max_len", "max_num", "max_whole")])
    nn = F.col("row_count") - F.col("null_n")
    seconds = lambda c: F.col(c) / F.lit(1e6)
    is_number = F.col("sum_num").isNotNull()
    return summed.select(
        "col_id", "row_count", nn.alias("non_null"), "distinct_values", "most", F.col("placeholder_n").alias("placeholder_count"),
        "blank_n", "min_len", (F.col("sum_len") / nn).alias("avg_len"), "max_len", F.col("email_n").alias("email_rows"),
        F.col("phone_n").alias("phone_rows"), (F.col("sum_num") / nn).alias("mean"), F.col("negative_n").alias("negatives"),
        F.when(is_number, F.col("min_num")).otherwise(seconds("min_whole")).alias("low"),
        F.when(is_number, F.col("max_num")).otherwise(seconds("max_whole")).alias("high"))


def extremes(counted: Counted) -> DataFrame:
    """(col_id, min_val, max_val): smallest and largest value of each column as text."""
    numeric = counted.of("numeric").groupBy("col_id").agg(
        F.min("num").alias("a"), F.max("num").alias("b"), F.min("whole").alias("c"), F.max("whole").alias("d"))
    numeric = numeric.select("col_id", F.coalesce(F.col("c").cast("string"), F.col("a").cast("string")).alias("min_val"),
                             F.coalesce(F.col("d").cast("string"), F.col("b").cast("string")).alias("max_val"))
    # ISO texts of dates sort like the dates
    other = counted.of("string", "temporal", "bool", "other").groupBy("col_id").agg(
        F.min("value").alias("min_val"), F.max("value").alias("max_val"))
    return numeric.unionByName(other)


def deviations(counted: Counted, means: DataFrame) -> DataFrame:
    """(col_id, stddev) around the known means (col_id, mean): one row per column."""
    spread = F.sum(F.col("n") * F.pow(F.col("num") - F.col("mean"), F.lit(2)))
    centred = counted.of("numeric").join(F.broadcast(means), "col_id")
    return centred.groupBy("col_id").agg(
        F.sqrt(spread / F.nullif(F.sum("n") - 1, F.lit(0))).alias("stddev"))


def type_hints(kinds: DataFrame) -> DataFrame:
    """(col_id, hint_type, hint_share, checked, date_formats, leading_zero_count) of text columns, from value_kinds.

    date_formats: array of (format, share of the dates), most frequent first."""
    real = F.col("kind").isNotNull()
    is_date = F.col("kind").startswith("date:")

    def rows_of(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))

    named = F.struct((-F.col("n")).alias("order"), F.substring("kind", 6, 20).alias("format"), F.col("n").alias("n"))
    per_column = kinds.groupBy("col_id").agg(
        rows_of(real).alias("checked"),
        F.count("kind").alias("kinds"),
        rows_of(F.col("kind") == "int").alias("ints"),
        rows_of(F.col("kind") == "decimal").alias("decimals"),
        rows_of(F.col("kind") == "bool").alias("bools"),
        rows_of(F.col("kind") == "timestamp").alias("moments"),
        rows_of(is_date).alias("dates"),
        F.sum("zeros").alias("zeros"),
        F.array_sort(F.collect_list(F.when(is_date, named))).alias("found"),    # one entry per known date format
    ).where("checked > 0")
    checked = F.col("checked")
    share = lambda *names: sum(F.col(x) for x in names) / checked
    zeros = F.when(F.col("ints") > 0, F.col("zeros")).otherwise(F.lit(0))
    no_zeros = zeros == 0
    hint = (
        F.when((share("ints") >= HINT_SHARE) & no_zeros, F.lit("BIGINT"))
        .when((share("ints", "decimals") >= HINT_SHARE) & (F.col("decimals") > 0) & no_zeros, F.lit("DECIMAL"))
        .when((share("bools") >= HINT_SHARE) & (F.col("kinds") == 1), F.lit("BOOLEAN"))
        .when((F.col("dates") > 0) & (share("dates") >= HINT_SHARE), F.lit("DATE"))
        .when((F.col("dates") + F.col("moments") > 0) & (share("dates", "moments") >= HINT_SHARE), F.lit("TIMESTAMP"))
    )
    by_type = (
        F.when(F.col("hint_type") == "BIGINT", share("ints"))
        .when(F.col("hint_type") == "DECIMAL", share("ints", "decimals"))
        .when(F.col("hint_type") == "BOOLEAN", share("bools"))
        .when(F.col("hint_type") == "DATE", share("dates"))
        .when(F.col("hint_type") == "TIMESTAMP", share("dates", "moments"))
    )
    formats = F.transform(
        "found", lambda x: F.struct(x["format"].alias("format"), F.round(x["n"] / F.col("dates"), 4).alias("share")))
    return per_column.withColumn("hint_type", hint).select(
        "col_id", "hint_type", F.round(by_type, 4).alias("hint_share"), "checked",
        F.when(F.col("hint_type").isNotNull(), formats).alias("date_formats"), zeros.alias("leading_zero_count"))


def numbers(counted: Counted) -> DataFrame:
    """(col_id, num, n) of the numeric columns."""
    return counted.of("numeric").select("col_id", "num", "n")


def moments(counted: Counted) -> DataFrame:
    """(col_id, num, n) of the temporal columns; num is microseconds."""
    return counted.of("temporal").select("col_id", F.col("whole").alias("num"), "n")


def number_quantiles(counted: Counted, max_distinct: int | None = None) -> DataFrame:
    """(col_id, p25, p50, p75), interpolated, in double."""
    q = quantiles(numbers(counted), [0.25, 0.5, 0.75], max_distinct=max_distinct)
    return q.select("col_id", *[F.col(f"q{i}").alias(p) for i, p in enumerate(("p25", "p50", "p75"))])


def moment_quantiles(counted: Counted, max_distinct: int | None = None) -> DataFrame:
    """(col_id, p25, p50, p75) as existing timestamps."""
    q = quantiles(moments(counted), [0.25, 0.5, 0.75], discrete=True, max_distinct=max_distinct)
    stamp = lambda i: F.timestamp_micros(f"q{i}")
    return q.select("col_id", *[stamp(i).alias(p) for i, p in enumerate(("p25", "p50", "p75"))])


def histograms(counted: Counted, bins: int = BINS, span: DataFrame | None = None) -> DataFrame:
    """(col_id, bin, lo, hi, n): equal-width bins of numeric and temporal columns, empty bins included.

    span: (col_id, low, high) when the caller has it."""
    x = F.when(F.col("family") == "temporal", F.col("whole") / F.lit(1e6)).otherwise(F.col("num"))
    points = counted.of("numeric", "temporal").select("col_id", x.alias("x"), "n")
    if span is None:
        span = held(points.groupBy("col_id").agg(F.min("x").alias("low"), F.max("x").alias("high")))
    span = span.select("col_id", "low", "high").where("high > low")
    place = F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins)
    in_bin = (
        points.join(F.broadcast(span), "col_id")
        .groupBy("col_id", F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.sum("n").alias("n"))
    )
    frame = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("high") - F.col("low")) / bins
    return frame.join(in_bin, ["col_id", "bin"], "left").select(
        "col_id", "bin",
        F.round(F.col("low") + F.col("bin") * width, 4).alias("lo"),
        F.round(F.col("low") + (F.col("bin") + 1) * width, 4).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def _fenced(counted: Counted, quartiles: DataFrame) -> DataFrame:
    """Numbers of measure columns with their outlier fences; columns without spread have none."""
    spread = F.col("p75") - F.col("p25")
    fences = quartiles.where(~F.col("col_id").isin(counted.key_like_ids()) & (spread > 0)).select(
        "col_id", (F.col("p25") - FENCE * spread).alias("fence_low"), (F.col("p75") + FENCE * spread).alias("fence_high"),
        ((F.col("p25") + F.col("p75")) / 2).alias("mid"))
    return numbers(counted).join(F.broadcast(fences), "col_id")       # one row per column


def outliers(counted: Counted, quartiles: DataFrame, keep: int = EXAMPLES) -> tuple[DataFrame, DataFrame]:
    """Far-out values: (counts and fences per column, the most extreme values)."""
    fenced = _fenced(counted, quartiles)
    outside = (F.col("num") < F.col("fence_low")) | (F.col("num") > F.col("fence_high"))
    per_column = fenced.groupBy("col_id").agg(
        F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("outlier_count"),
        F.round(F.max("fence_low"), 6).alias("outlier_low"), F.round(F.max("fence_high"), 6).alias("outlier_high"))
    far = fenced.where(outside).groupBy("col_id", "num", "mid").agg(F.sum("n").alias("n"))
    extreme = top_per_group(far, ["col_id"],
                            [F.desc(F.abs(F.col("num") - F.col("mid"))), F.asc("num")], keep)
    return per_column, extreme.select("col_id", "rank", F.col("num").alias("value"), "n")


def _texts(quartiles: DataFrame) -> DataFrame:
    return quartiles.select("col_id", *[F.col(p).cast("string").alias(p) for p in ("p25", "p50", "p75")])


def _flags(name: Column) -> Column:
    nn, rows, d = F.col("non_null"), F.col("row_count"), F.col("distinct_count")
    unique = (nn > 0) & (d >= nn) & ~F.col("approx")
    key_type = (F.col("family") == "string") | (
        (F.col("family") == "numeric") & ~F.col("data_type").rlike("^(float|double)"))
    email = (nn > 0) & (F.col("email_rows") / nn > PII_SHARE)
    phone = (nn > 0) & (F.col("phone_rows") / nn > PII_SHARE) & name.rlike(PII_NAME)
    whole = nn == rows
    tests = [
        ("all_null", nn == 0),
        ("constant", (nn > 0) & (d == 1)),
        ("candidate_pk", unique & whole & key_type),
        ("unique", unique & whole & ~key_type),
        ("unique_with_nulls", unique & ~whole),
        ("high_null", (nn > 0) & (F.col("null_pct") >= HIGH_NULL_PCT)),
        ("pii_email", email),
        ("pii_phone", phone),
        ("pii_name_hint", name.rlike(PII_NAME) & ~F.coalesce(email, F.lit(False)) & ~F.coalesce(phone, F.lit(False))),
        ("mixed_format", (F.size("patterns") > 1) & (d > 1) & (F.col("same_shape_rows") / nn < ONE_FORMAT_SHARE)),
        ("has_blanks", F.col("blank_count") > 0),
        ("placeholders", F.col("placeholder_count") > 0),
        ("type_hint", F.col("hint_type").isNotNull()),
        ("leading_zeros", F.col("leading_zero_count") > 0),
        ("outliers", F.col("outlier_count") > 0),
        ("negatives", (F.col("negative_count") > 0) & (F.col("negative_count") <= FEW_NEGATIVES * nn)),
    ]
    return F.filter(F.array(*[F.when(test, F.lit(flag)) for flag, test in tests]), lambda x: x.isNotNull())


def with_flags(profile: DataFrame) -> DataFrame:
    """(Re)compute the flags, e.g. after whole-table counts replaced those of a sample."""
    return profile.withColumn("flags", _flags(F.col("column_name")))


@small_tasks
def profile(tables: Tables, approx: bool = False, columns: list[ColumnMeta] | None = None,
            counted: Counted | None = None, top_n: int = TOP_VALUES) -> DataFrame:
    """One row per column with every statistic, staged. approx: distinct counts are estimates and uniqueness is not
    claimed."""
    counted = counted or count_values(tables, columns)
    # a few rows per column each; later steps carry them in the plan
    kinds = held(value_kinds(counted))
    sums = held(value_sums(kinds))
    most = {r["col_id"]: r["distinct_values"] for r in sums.collect()}
    largest = lambda *fams: max([most.get(i, 0) for i in counted.ids(*fams)], default=0)
    stats, quarts, frequent, shaped, odd, bars = together(
        lambda: held(extremes(counted).join(deviations(counted, sums.select("col_id", "mean")), "col_id", "left")),
        lambda: held(_texts(number_quantiles(counted, largest("numeric"))).unionByName(
            _texts(moment_quantiles(counted, largest("temporal"))))),
        lambda: held(top_values(counted, top_n)), lambda: held(patterns(counted)), lambda: held(placeholders(counted)),
        lambda: held(histograms(counted, span=sums)))
    if approx:
        stats = stats.join(whole_counts(tables, counted.metas).select("col_id", "approx_distinct"), "col_id", "left")
    fences = quarts.where(F.col("col_id").isin(counted.ids("numeric"))).select(
        "col_id", *[F.col(p).cast("double").alias(p) for p in ("p25", "p50", "p75")])
    out_counts, out_values = outliers(counted, fences)
    text_rows = lambda df, name: df.select(
        "col_id", F.lit(name).alias("part"), "rank", F.col(df.columns[2]).cast("string").alias("value"),
        F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), "n")
    ranked = union_all([
        text_rows(frequent, "top_values"), text_rows(shaped, "patterns"),
        text_rows(odd, "placeholder_values"),
        *[df.select("col_id", F.lit(part).alias("part"), F.col(rank).alias("rank"),
                    F.lit(None).cast("string").alias("value"), lo.alias("lo"), hi.alias("hi"), "n")
          for df, part, rank, lo, hi in (
              (out_values, "outlier_values", "rank", F.col("value"), F.lit(None).cast("double")),
              (bars, "histogram", "bin", F.col("lo"), F.col("hi")),
              (out_counts.withColumn("n", F.col("outlier_count")), "fences", "outlier_count", F.col("outlier_low"),
               F.col("outlier_high")))],
    ])
    lists = held(ranked)            # at most 10 + 8 + 5 + 5 + 20 + 1 rows per column
    # each list becomes an array column of its own
    array_of = lambda part, *fields: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("rank", *fields)))),
        lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    arrays = lists.groupBy("col_id").agg(
        array_of("top_values", "value", "n").alias("top_values"),
        F.transform(array_of("patterns", "value", "n"),
                    lambda x: F.struct(x["value"].alias("shape"), x["n"].alias("n"))).alias("patterns"),
        array_of("placeholder_values", "value", "n").alias("placeholder_values"),
        array_of("histogram", "lo", "hi", "n").alias("histogram"),
        F.transform(array_of("outlier_values", "lo", "n"),
                    lambda x: F.struct(x["lo"].alias("value"), x["n"].alias("n"))).alias("outlier_values"),
        F.max(F.when(F.col("part") == "fences", F.col("n"))).alias("outlier_count"),
        F.max(F.when(F.col("part") == "fences", F.col("lo"))).alias("outlier_low"),
        F.max(F.when(F.col("part") == "fences", F.col("hi"))).alias("outlier_high"))
    same_shape = (
        lists.where("part = 'patterns'").groupBy("col_id", V.squeezed_shape(F.col("value")).alias("s"))
        .agg(F.sum("n").alias("n")).groupBy("col_id").agg(F.max("n").alias("same_shape_rows")))
    joined = counted.columns.join(sums, "col_id", "left").na.fill(0, ["row_count", "non_null", "distinct_values"])
    text = F.col("family") == "string"
    joined = joined.withColumn("blank_count", F.when(text, F.coalesce("blank_n", F.lit(0))))
    for part in (stats, type_hints(kinds), arrays, same_shape, quarts):
        joined = joined.join(part, "col_id", "left")
    is_measured = (F.col("family") == "numeric") & (F.col("non_null") > 0) & ~F.col("column_name").rlike(KEYISH_NAME)
    empty = (F.col("row_count") - F.col("non_null")) + F.coalesce("blank_count", F.lit(0)) + F.coalesce(
        "placeholder_count", F.lit(0))
    exact = F.coalesce("distinct_values", F.lit(0))
    full = joined.select(
        "col_id", "schema_name", "table_name", "column_name", "ordinal", "data_type", "family", "row_count", "non_null",
        (F.col("row_count") - F.col("non_null")).alias("null_count"),
        pct(F.col("row_count") - F.col("non_null"), F.col("row_count")).alias("null_pct"),
        "blank_count",
        (F.col("approx_distinct") if approx else exact).alias("distinct_count"),
        pct(F.col("approx_distinct") if approx else exact, F.col("non_null")).alias("distinct_pct"),
        V.shown(F.col("min_val")).alias("min_val"), V.shown(F.col("max_val")).alias("max_val"),
        "mean", "stddev", "p25", "p50", "p75", "min_len", F.round("avg_len", 2).alias("avg_len"), "max_len",
        "low", "high", "email_rows", "phone_rows", "same_shape_rows",
        *[F.coalesce(x, F.array()).alias(x) for x in ("top_values", "patterns", "histogram", "placeholder_values",
                                                       "outlier_values")],
        F.coalesce("placeholder_count", F.lit(0)).alias("placeholder_count"),
        pct(empty, F.col("row_count")).alias("effective_null_pct"),
        "hint_type", "hint_share", "checked", "date_formats",
        F.coalesce("leading_zero_count", F.lit(0)).alias("leading_zero_count"),
        F.when(is_measured, F.coalesce("outlier_count", F.lit(0))).alias("outlier_count"), "outlier_low", "outlier_high",
        F.when(is_measured, F.col("negatives")).alias("negative_count"),
        F.lit(approx).alias("approx"),
    )
    return stage(with_flags(full), "profile")


def approx_distinct(tables: Tables, metas: list[ColumnMeta] | None = None, near_unique: float = 0.95) -> DataFrame:
    """(col_id, non_null, approx_distinct, exact_distinct): estimates for all columns without a shuffle of values, exact
    counts only for columns that may be unique."""
    metas = column_list(tables) if metas is None else metas
    return _exact_if_near(tables, metas, held(whole_counts(tables, metas)), near_unique)


def _exact_if_near(tables: Tables, metas: list[ColumnMeta], stats: DataFrame, near_unique: float = 0.95) -> DataFrame:
    stats = stats.select("col_id", "non_null", "approx_distinct")
    close = {r["col_id"] for r in stats.where(F.col("approx_distinct") >= near_unique * F.col("non_null")).collect()}
    chosen = [m for m in metas if m.col_id in close]
    if not chosen:
        return stats.withColumn("exact_distinct", F.lit(None).cast("bigint"))
    exact = value_freq(tables, chosen).groupBy("col_id").agg(F.count("value").alias("exact_distinct"))
    return stats.join(exact, "col_id", "left")


def whole_table_profile(tables: Tables, sample_rows: int, seed: int = 42) -> DataFrame:
    """Details (frequent values, shapes, quantiles, histogram) from a sample of each bigger table; counts, extremes and
    distinct counts from the whole table, and so are negatives, placeholders and the values beyond the sample's fences; the
    flags follow the whole-table numbers."""
    sizes = {name: df.count() for name, df in tables.items()}
    drawn = {name: df if sizes[name] <= sample_rows else df.sample(sample_rows / sizes[name], seed)
             for name, df in tables.items()}
    detail = profile(drawn)
    metas = column_list(tables)
    names = column_frame(next(iter(tables.values())).sparkSession, metas).select("col_id", "column_name")
    whole = held(whole_counts(tables, metas, _fences(detail)))
    distinct = _exact_if_near(tables, metas, whole).select(
        "col_id", F.coalesce("exact_distinct", "approx_distinct").alias("_distinct"))
    counts = whole.select(
        "col_id", F.col("row_count").alias("_rows"), F.col("non_null").alias("_nn"), F.col("blank_count").alias("_blank"),
        V.shown(F.col("min_val")).alias("_min"), V.shown(F.col("max_val")).alias("_max"), F.col("negative_count").alias("_negative"),
        F.col("placeholder_count").alias("_odd"), F.col("outlier_count").alias("_outside"))
    whole = names.join(counts, "col_id").join(distinct, "col_id").drop("column_name")
    is_measured = (F.col("family") == "numeric") & (F.col("_nn") > 0) & ~F.col("column_name").rlike(KEYISH_NAME)
    empty = F.col("_rows") - F.col("_nn") + F.coalesce("_blank", F.lit(0)) + F.col("_odd")
    merged = detail.withColumn("_sampled", F.col("non_null")).join(whole, "col_id").withColumns({
        "row_count": F.col("_rows"), "non_null": F.col("_nn"), "null_count": F.col("_rows") - F.col("_nn"),
        "null_pct": pct(F.col("_rows") - F.col("_nn"), F.col("_rows")), "blank_count": F.coalesce("_blank", "blank_count"),
        "min_val": F.coalesce("_min", "min_val"), "max_val": F.coalesce("_max", "max_val"),
        "distinct_count": F.col("_distinct"), "distinct_pct": pct(F.col("_distinct"), F.col("_nn")),
        "placeholder_count": F.col("_odd"), "effective_null_pct": pct(empty, F.col("_rows")),
        "negative_count": F.when(is_measured, F.col("_negative")), "outlier_count": F.when(is_measured, F.col("_outside"))})
    grown = F.col("_nn") / F.nullif(F.col("_sampled"), F.lit(0))
    merged = merged.withColumns({c: F.coalesce(F.round(F.col(c) * grown).cast("bigint"), F.col(c))
                                 for c in ("email_rows", "phone_rows", "same_shape_rows")})
    return stage(with_flags(merged.select(*detail.columns)), "profile")


def _fences(profiled: DataFrame) -> dict[int, tuple[float, float]]:
    """Outlier fences of the measure columns of a profile, from its quartiles."""
    quartiles = profiled.where((F.col("family") == "numeric") & F.col("p25").isNotNull()).select("col_id", "column_name", "p25", "p75")
    found = {r["col_id"]: (float(r["p25"]), float(r["p75"])) for r in quartiles.collect() if not keyish(r["column_name"])}
    return {i: (low - FENCE * (high - low), high + FENCE * (high - low)) for i, (low, high) in found.items() if high > low}


def resilient_profile(tables: Tables) -> DataFrame:
    """profile(); a column that cannot be profiled keeps its counts and the flag profile_error and does not lose the
    table. Values are read with try_ functions, so only a column that cannot be read at all gets here."""
    try:
        return profile(tables)
    except Exception:  # noqa: BLE001 - find the column
        parts = []
        for m in column_list(tables):
            name = next(n for n in tables if split_name(n) == (m.schema_name, m.table_name))
            one = {name: tables[name].select(col(m.column_name))}
            try:
                part = profile(one)
            except Exception:  # noqa: BLE001
                part = _counts_only(tables[name], m)
            parts.append(part.withColumns({"col_id": F.lit(m.col_id), "ordinal": F.lit(m.ordinal)}))
        from functools import reduce

        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _counts_only(df: DataFrame, m: ColumnMeta) -> DataFrame:
    rows = df.agg(F.count(F.lit(1)).alias("row_count"))
    return rows.select(
        F.lit(m.schema_name).alias("schema_name"), F.lit(m.table_name).alias("table_name"),
        F.lit(m.column_name).alias("column_name"), F.lit(m.data_type).alias("data_type"), F.lit(m.family).alias("family"),
        "row_count", F.array(F.lit("profile_error")).alias("flags"))


def precision_overflow(df: DataFrame, declared: dict[str, T.DecimalType]) -> DataFrame:
    """(column_name, declared_type, max_abs) of columns with values that need more digits before the point than their
    declared type has. df holds them in a wider type."""
    row = F.array(*[F.struct(
        F.lit(name).alias("column_name"), F.lit(kind.simpleString()).alias("declared_type"),
        F.max(F.abs(col(name).cast("double"))).alias("max_abs"),
        F.lit(float(10 ** (kind.precision - kind.scale))).alias("limit")) for name, kind in declared.items()])
    found = df.agg(row.alias("r")).select(F.inline("r"))
    return found.where(F.col("max_abs") >= F.col("limit")).select("column_name", "declared_type", "max_abs")


KEY_DISTINCT = 0.98


def key_fingerprints(counted: Counted, profiled: DataFrame, cap: int | None = None) -> DataFrame:
    """(col_id, value, complete): distinct values of key-like columns (id-like name, or at least 98 % distinct).

    Whole unless a cap is asked for; then a share of the values chosen by their hash, about `cap` of them."""
    d, filled = F.col("distinct_count"), F.col("non_null")
    whole_type = (F.col("family") == "string") | (
        (F.col("family") == "numeric") & ~F.col("data_type").rlike("^(float|double)"))
    named = F.col("column_name").rlike(KEYISH_NAME) | (d >= KEY_DISTINCT * filled)
    keys = profiled.where(whole_type & named & (d >= 2)).select("col_id", "distinct_count")
    values = keys.join(counted.freq, "col_id")
    if cap is None:
        return values.select("col_id", "value", F.lit(True).alias("complete"))
    share = F.pmod(F.xxhash64("value"), F.lit(1_000_000)) < F.lit(cap) / F.col("distinct_count") * 1_000_000
    return values.where(share).select("col_id", "value", (F.col("distinct_count") <= cap).alias("complete"))


def table_profile(profiled: DataFrame) -> DataFrame:
    """One row per table: row and column counts, candidate keys."""
    key = F.when(F.array_contains("flags", "candidate_pk"), F.struct("ordinal", "column_name"))
    return profiled.groupBy("schema_name", "table_name").agg(
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        F.transform(F.array_sort(F.collect_list(key)), lambda x: x["column_name"]).alias("candidate_keys"))


def candidate_keys(profiled: DataFrame) -> DataFrame:
    """Columns that are unique, never null and of a key-like type."""
    return profiled.where(F.array_contains("flags", "candidate_pk")).select("schema_name", "table_name", "column_name")
