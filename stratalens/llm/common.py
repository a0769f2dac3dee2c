"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows that a join may broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tidied(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over the batches of a partition that gives the memory it no longer needs back to the system when it ends: Python workers live
    on, and what one task has freed would else count as an executor's memory through all later ones."""

    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it (Spark's names don't tell case apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def own(df: DataFrame) -> list[Column]:
    """The columns of df, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def bucket(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo parts; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def words(text: Column) -> Column:
    """Words between spaces, tabs, line feeds, vertical tabs, form feeds and carriage returns, A-Z in lower case; none for null."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), upper, lower), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def fitting(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written or cached df of a counted size: marked for broadcast up to that many rows, else left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def pieces(sizes: list[int], most: int) -> Iterator[slice]:
    """Consecutive slices of a batch whose sizes add up to about `most`, at least one row each."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))
