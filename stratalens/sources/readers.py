"""Readers by format. A reader is a function (spark, paths, options) -> DataFrame; new formats are registered."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

Reader = Callable[[SparkSession, list[str], dict], DataFrame]
READERS: dict[str, Reader] = {}
EXTENSIONS: dict[str, str] = {}


def register_reader(name: str, extensions: list[str], reader: Reader) -> None:
    READERS[name] = reader
    EXTENSIONS.update({e: name for e in extensions})


def format_of(path: str) -> str | None:
    """The format of a file by the longest registered extension it ends with."""
    fits = [e for e in EXTENSIONS if path.lower().endswith(e)]
    return EXTENSIONS[max(fits, key=len)] if fits else None


def read(spark: SparkSession, fmt: str, paths: list[str], options: dict | None = None) -> DataFrame:
    return READERS[fmt](spark, paths, options or {})


def read_parquet(spark: SparkSession, paths: list[str], options: dict | None = None) -> DataFrame:
    """Files, folders or globs as one table: columns are matched by name, key=value folders become columns."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def read_csv(spark: SparkSession, paths: list[str], options: dict | None = None) -> DataFrame:
    """Text tables with a header, types inferred from all rows or everything text.

    options: all_text, delimiter. Files with different columns are united by name, so files are read one by one only
    where their headers differ."""
    options = options or {}
    first = paths[0].lower()
    tabbed = first.endswith((".tsv", ".tsv.gz"))
    base = spark.read.option("header", True).option("sep", options.get("delimiter") or ("\t" if tabbed else ","))
    base = base.option("escape", '"').option("multiLine", bool(options.get("multiline", False)))

    def one(some: list[str]) -> DataFrame:
        return base.option("inferSchema", not options.get("all_text", False)).csv(some)

    if len(paths) == 1:
        return one(paths)
    headers: dict[tuple, list[str]] = {}
    for path in paths:
        header = tuple(base.option("inferSchema", False).csv(path).columns)     # reads one line
        headers.setdefault(header, []).append(path)
    parts = [one(files) for files in headers.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), _same_types(parts))


def _same_types(parts: list[DataFrame]) -> list[DataFrame]:
    """Columns inferred differently in different files become text."""
    from pyspark.sql import functions as F

    from stratalens.types import col

    kinds: dict[str, set] = {}
    for df in parts:
        for f in df.schema.fields:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    mixed = {n for n, k in kinds.items() if len(k) > 1}
    return [df.withColumns({n: F.col(f"`{n}`").cast("string") for n in df.columns if n in mixed}) if mixed & set(df.columns)
            else df.select(*[col(n) for n in df.columns]) for df in parts]


def read_json(spark: SparkSession, paths: list[str], options: dict | None = None) -> DataFrame:
    """One JSON object per line, or (multiline) whole documents: arrays or objects. Strings stay strings."""
    options = options or {}
    whole = options.get("multiline")
    if whole is None:
        whole = any(p.lower().endswith((".json", ".json.gz")) and _starts_with_bracket(spark, p) for p in paths)
    return spark.read.option("multiLine", bool(whole)).option("primitivesAsString", False).json(paths)


def _starts_with_bracket(spark: SparkSession, path: str) -> bool:
    """Is a .json file one array (or a pretty-printed object)? Decided by its first line that is not empty."""
    for row in spark.read.text(path).limit(20).collect():
        line = row[0].strip()
        if line:
            return line.startswith("[") or line == "{"
    return False


def read_pipe_delimited(spark: SparkSession, paths: list[str], options: dict | None = None) -> DataFrame:
    return read_csv(spark, paths, {**(options or {}), "delimiter": "|"})


register_reader("csv", [".csv", ".csv.gz", ".tsv", ".tsv.gz", ".txt"], read_csv)
register_reader("parquet", [".parquet", ".pq"], read_parquet)
register_reader("json", [".json", ".jsonl", ".ndjson", ".json.gz", ".jsonl.gz", ".ndjson.gz"], read_json)
