"""Intermediate results that several jobs read are written once to the cluster's shared checkpoint folder.

A written table survives the loss of executors, cuts the lineage of iterative jobs and keeps Parquet's column pruning
and filter pushdown for every later read.
"""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

# Most bytes one task reads of a file and of a shuffle; counts and sorts take some 25 times that in memory. Fewest partitions
# a shuffle is cut into before small ones are put together, and how many for each one the session asks for.
SPLIT_BYTES, SHUFFLE_BYTES, SHUFFLE_PARTS, PARTS_FACTOR = 16 << 20, 8 << 20, 400, 4

def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only for an unset local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df once and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_parts(parts: dict[str, DataFrame], label: str, column: str) -> DataFrame:
    """Write frames of one schema, each under its value of the column, and read them as one table. No task sorts or holds rows for that."""
    first = next(iter(parts.values()))
    spark = first.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    together(*[lambda v=v, df=df: df.drop(column).write.parquet(f"{path}/{column}={v}") for v, df in parts.items()])
    return spark.read.schema(first.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """A result of a few rows per column of the catalog, computed once and kept in the plan.

    Only for metadata: the row count must be bounded by the number of columns, never by the number of rows."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def together(*jobs: Callable, at_once: int = 4) -> list:
    """Run independent jobs at the same time, so that small ones share the cluster; results in the order given."""
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


_inside: dict[SparkSession, tuple[int, dict[str, str | None]]] = {}       # by session: jobs that run, settings from before the first
_lock = threading.Lock()


def _bytes(setting: str) -> int:
    number, unit = re.fullmatch(r"\s*(\d+)\s*([bkmgtp]?)b?\s*", setting.lower()).groups()
    return int(number) << (10 * "bkmgtp".index(unit or "b"))


def _task_sizes(spark: SparkSession) -> dict[str, str]:
    """Settings for small tasks; what the session sets smaller (or, for partitions, more) stays."""
    conf, most = spark.conf, {"spark.sql.files.maxPartitionBytes": SPLIT_BYTES, "spark.sql.adaptive.advisoryPartitionSizeInBytes": SHUFFLE_BYTES}
    sizes = {key: str(size) for key, size in most.items() if _bytes(conf.get(key)) > size}
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    parts = max(SHUFFLE_PARTS, PARTS_FACTOR * int(conf.get("spark.sql.shuffle.partitions")))
    return sizes if int(conf.get(key, None) or 0) >= parts else sizes | {key: str(parts)}


def small_tasks(job: Callable) -> Callable:
    """A job whose tasks read a bounded number of bytes, whatever its input: more input gives more tasks, not larger ones.

    job takes a DataFrame or a dict of them first. The session's settings are changed while such jobs run and put back after the last."""

    @wraps(job)
    def run(first, *args, **kwargs):
        spark = (first if isinstance(first, DataFrame) else next(iter(first.values()))).sparkSession
        # threads of one session share its settings
        with _lock:
            running, before = _inside.get(spark, (0, {}))
            if not running:
                sizes = _task_sizes(spark)
                before = {key: spark.conf.get(key, None) for key in sizes}
                for key, size in sizes.items():
                    spark.conf.set(key, size)
            _inside[spark] = running + 1, before
        try:
            return job(first, *args, **kwargs)
        finally:
            with _lock:
                running, before = _inside.pop(spark)
                if running > 1:
                    _inside[spark] = running - 1, before
                else:
                    for key, size in before.items():
                        spark.conf.unset(key) if size is None else spark.conf.set(key, size)

    return run
