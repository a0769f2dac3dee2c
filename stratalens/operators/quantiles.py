"""Exact quantiles of many columns at once from value counts.

The rank of a value is the running sum of counts. Up to WINDOW_ROWS distinct values per column one window computes it;
beyond, the values are range-partitioned and written with their partition number, so a window only ever covers one
range and the ranges before it contribute their total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.staging import stage

WINDOW_ROWS = 1_000_000


def _needed_ranks(p: float, total: Column, discrete: bool) -> tuple[Column, Column]:
    """0-based ranks of the two values a quantile lies between."""
    if discrete:
        at = F.greatest(F.ceil(total * F.lit(p)) - 1, F.lit(0)).cast("long")
        return at, at
    place = F.lit(p) * (total - 1)
    return F.floor(place).cast("long"), F.ceil(place).cast("long")


def quantiles(
    counts: DataFrame,
    probabilities: list[float],
    discrete: bool = False,
    max_distinct: int | None = None,
    group: str = "col_id",
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """(group, q0, q1, ...) for counts(group, num, n): one row per distinct num.

    max_distinct: the most distinct values any group has, when the caller knows it already.
    """
    if max_distinct is None:
        largest = counts.groupBy(group).count().agg(F.max("count")).first()
        max_distinct = largest[0] or 0
    totals = counts.groupBy(group).agg(F.sum("n").alias("total"))
    if max_distinct <= window_rows:
        ranked = counts.withColumn("seen", F.sum("n").over(_running(group))).join(totals, group)
    else:
        ranked = _ranked_by_range(counts, totals, probabilities, discrete, group)
    ranked = ranked.withColumn("before", F.col("seen") - F.col("n"))
    picks = []
    for i, p in enumerate(probabilities):
        lo, hi = _needed_ranks(p, F.col("total"), discrete)
        picks += [F.max(F.when(_covers(lo), F.col("num"))).alias(f"lo{i}"),
                  F.max(F.when(_covers(hi), F.col("num"))).alias(f"hi{i}")]
    found = ranked.groupBy(group).agg(F.max("total").alias("total"), *picks)
    out = [F.col(group)]
    for i, p in enumerate(probabilities):
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        if discrete:
            out.append(lo.alias(f"q{i}"))
        else:
            place = F.lit(p) * (F.col("total") - 1)
            out.append((lo + (place - F.floor(place)) * (hi - lo)).alias(f"q{i}"))
    return found.select(*out)


def _running(*group: str):
    return Window.partitionBy(*group).orderBy("num").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _covers(rank: Column) -> Column:
    return (F.col("before") <= rank) & (rank < F.col("seen"))


def _ranked_by_range(counts: DataFrame, totals: DataFrame, probabilities: list[float], discrete: bool,
                     group: str) -> DataFrame:
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(
        counts.repartitionByRange(parts, group, "num").withColumn("range_id", F.spark_partition_id()), "ranges"
    )
    # one row per group and range: at most columns x shuffle partitions
    sizes = ranged.groupBy(group, "range_id").agg(F.sum("n").alias("range_n"))
    earlier = Window.partitionBy(group).orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("start", F.coalesce(F.sum("range_n").over(earlier), F.lit(0))).join(totals, group)
    end = F.col("start") + F.col("range_n")
    holds = F.lit(False)
    for p in probabilities:
        for rank in _needed_ranks(p, F.col("total"), discrete):
            holds = holds | ((F.col("start") <= rank) & (rank < end))
    inside = ranged.join(sizes.where(holds).drop("range_n"), [group, "range_id"])
    return inside.withColumn("seen", F.col("start") + F.sum("n").over(_running(group, "range_id")))
