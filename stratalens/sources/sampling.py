"""Smaller copies of big tables: random, first rows, filtered, or consistent across linked tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.types import col

BUCKETS = 1_000_000
DEFAULT_ROWS = 300_000
HEADROOM = 1.1


def key_bucket(name: str) -> Column:
    """Bucket of a key by its text form, the same on both sides of a link whatever the column types."""
    return F.pmod(F.xxhash64(col(name).cast("string")), F.lit(BUCKETS))


def materialise_sample(df: DataFrame, path: str, rows: int = DEFAULT_ROWS, total: int | None = None, mode: str = "random",
                       where: str | None = None, key: str | None = None, ppm: int | None = None,
                       seed: int = 42) -> tuple[DataFrame, dict]:
    """Copy a table to Parquet: whole if it has at most `rows` rows, else a sample.

    mode: random (a share of the rows), first, filter (all rows where the condition holds), key (rows whose key falls
    in the first `ppm` of a million buckets). Returns the copy and what it is."""
    total = df.count() if total is None else total
    if mode == "filter":
        chosen, method = df.where(where), f"filter: {where}"
    elif mode == "key" and ppm is not None:
        chosen, method = df.where(key_bucket(key) < ppm), f"key: {key} < {ppm} ppm"
    elif total <= rows:
        chosen, method = df, "whole"
    elif mode == "first":
        chosen, method = df.limit(rows), "first"
    else:
        # a share with some headroom, then exactly `rows` of it in a repeatable random order, cut per task
        share = min(1.0, rows / total * HEADROOM)
        drawn = df.sample(share, seed).withColumn("_draw", F.rand(seed))
        chosen, method = drawn.orderBy("_draw").limit(rows).drop("_draw"), "random"
    chosen.write.mode("overwrite").parquet(path)
    copy = df.sparkSession.read.parquet(path)
    held = copy.count()
    return copy, {"cached_rows": held, "total_rows": total, "complete": held == total, "method": method}


def plan_key_samples(links: list[dict], sizes: dict[str, int], limits: dict[str, int] | None = None,
                     min_confidence: float = 0.8) -> dict[str, dict]:
    """{table: {column, ppm, group}}: linked big tables sampled on the same range of key buckets, so every sampled child
    row finds its parent. A child whose parent is sampled on another column is left to a random sample.

    links: rows of `relationships` as dictionaries; sizes: rows of the tables that are too big to copy whole."""
    limits = limits or {}
    name = lambda r, end: f"{r[end + '_schema']}.{r[end + '_table']}"
    column: dict[str, str] = {}
    group: dict[str, str] = {}
    for r in sorted(links, key=lambda r: -r["confidence"]):
        child, parent = name(r, "from"), name(r, "to")
        if r["confidence"] < min_confidence or child == parent or child not in sizes or parent not in sizes:
            continue
        if parent not in column:
            column[parent], group[parent] = r["to_column"], parent
        if column[parent] == r["to_column"] and child not in column:
            column[child], group[child] = r["from_column"], group[parent]
    plan = {}
    for table in column:
        members = [t for t in column if group[t] == group[table]]
        if len(members) < 2:
            continue
        share = min(limits.get(t, DEFAULT_ROWS) / sizes[t] for t in members)
        plan[table] = {"column": column[table], "ppm": min(BUCKETS, max(1, int(share * BUCKETS))), "group": group[table]}
    return plan


def key_sample(df: DataFrame, column: str, ppm: int) -> DataFrame:
    return df.where(key_bucket(column) < ppm)
