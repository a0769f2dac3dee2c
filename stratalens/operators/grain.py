"""The grain of a table: the smallest set of columns that makes every row unique."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from stratalens.operators.codes import is_code
from stratalens.staging import together
from stratalens.types import GRAIN_NAME, col, dateish, is_measure_type, keyish

# Share of distinct rows that counts as nearly unique, average length above which a text column is prose.
NEARLY, LONG_TEXT = 0.999, 60
# Combinations counted in one job, and rows on which combinations are searched before they are counted on all.
COUNTED, SAMPLE_ROWS = 16, 10_000


def column_infos(profiled: DataFrame, schema: str, table: str) -> list[dict]:
    """Profile rows of one table (one per column), in column order: what the driver plans the next jobs from."""
    rows = profiled.where((F.col("schema_name") == schema) & (F.col("table_name") == table)).orderBy("ordinal").select(
        "column_name", "data_type", "family", "row_count", "non_null", "distinct_count", "avg_len", "ordinal", "flags",
        "hint_type", "date_formats", "effective_null_pct", F.expr("get(top_values, 0).n").alias("top_n"), is_code().alias("code_list"))
    return [r.asDict(recursive=True) for r in rows.collect()]


def is_measure(info: dict) -> bool:
    """Amounts and free numbers: neither keys nor codes."""
    if info["family"] == "numeric" and is_measure_type(info["data_type"]):
        return True
    mostly_distinct = info["non_null"] and info["distinct_count"] / info["non_null"] > 0.5
    return bool(mostly_distinct) and not keyish(info["column_name"]) and info["family"] != "temporal"


def is_prose(info: dict) -> bool:
    return info["family"] == "string" and (info["avg_len"] or 0) > LONG_TEXT


def grain_candidates(infos: list[dict], order: list[str] | None = None) -> list[dict]:
    """Columns that can be part of a composite grain: without nulls, more than one value, no amounts and no prose. Those named in `order` come
    first, as they stand there; then those whose name tells of keys or dates, then those of more values."""
    given = {name: i for i, name in enumerate(order or [])}

    def place(info: dict) -> tuple[int, int, int]:
        name = info["column_name"]
        told = keyish(name) or dateish(name) or re.search(GRAIN_NAME, name) is not None
        return given.get(name, len(given)), 0 if told else 1, -info["distinct_count"]

    def fit(info: dict) -> bool:
        full, varied = info["non_null"] == info["row_count"], info["distinct_count"] > 1
        amount = info["family"] == "numeric" and is_measure_type(info["data_type"])
        return full and varied and info["family"] != "other" and not amount and not is_prose(info)

    return sorted(filter(fit, infos), key=place)


def count_combos(df: DataFrame, combos: list[list[str]]) -> list[int]:
    """Distinct rows of every combination, all in one job."""
    counts = df.agg(*[F.count_distinct(*[col(c) for c in combo]).alias(str(i)) for i, combo in enumerate(combos)])
    return list(counts.first())


def count_combo(df: DataFrame, combo: list[str], slots: int = 50) -> tuple[int, list[int]]:
    """Distinct rows of a combination, and hashes of some combinations that stand on several rows, one of each slot that has any.

    Only the combination itself and a count are shuffled."""
    names = [f"key{i}" for i in range(len(combo))]
    counted = df.groupBy(*[col(c).alias(n) for c, n in zip(combo, names, strict=True)]).agg(F.count(F.lit(1)).alias("n"))
    full, mark = F.lit(True), F.xxhash64(*names)
    for n in names:
        full = full & F.col(n).isNotNull()
    found = counted.groupBy(F.pmod(mark, F.lit(slots)).alias("slot")).agg(
        F.count_if(full).alias("d"), F.max(F.when(F.col("n") > 1, mark)).alias("mark")).collect()
    return sum(r["d"] for r in found), [r["mark"] for r in found if r["mark"] is not None]


class Search:
    """Smallest sets of columns that tell all given rows apart, as smallest sets that meet every difference: of two rows, the columns in which
    they differ. Differences are found as they are needed, from two rows that a set leaves together.

    rows: distinct rows as numbers; distinct: values of each column, and target: rows to tell apart, both of the whole table."""

    def __init__(self, rows: np.ndarray, distinct: list[int], target: int):
        self.rows, self.distinct, self.target = rows, distinct, target
        self.differences: list[frozenset[int]] = []
        self.known: set[frozenset[int]] = set()
        for c in range(rows.shape[1]):
            self.differ(np.lexsort((rows[:, c], *[rows[:, x] for x in range(rows.shape[1]) if x != c])), None)

    def add(self, rows: np.ndarray) -> None:
        self.rows = np.unique(np.concatenate([self.rows, rows]), axis=0)

    def differ(self, order: np.ndarray, group: np.ndarray | None) -> None:
        """Notes how neighbours in this order differ (those of one group): the differences that hold no other."""
        a, b = self.rows[order[:-1]], self.rows[order[1:]]
        if group is not None:
            same = group[order[:-1]] == group[order[1:]]
            a, b = a[same], b[same]
        masks = np.unique(a != b, axis=0)
        for mask in masks[np.argsort(masks.sum(1), kind="stable")][:200]:
            found = frozenset(np.flatnonzero(mask).tolist())
            if found and found not in self.known and not any(d <= found for d in self.differences):
                self.known.add(found)
                self.differences.append(found)
        self.differences.sort(key=len)

    def groups(self, chosen: frozenset[int]) -> np.ndarray:
        code = np.zeros(len(self.rows), np.int64)
        for c in chosen:
            code = np.unique(code * (int(self.rows[:, c].max()) + 1) + self.rows[:, c], return_inverse=True)[1].reshape(-1)
        return code

    def able(self, chosen: frozenset[int], out: frozenset[int], size: int, code: np.ndarray) -> bool:
        """Whether columns of the largest numbers of values could split what is left, by their product."""
        free = sorted((d for c, d in enumerate(self.distinct) if c not in chosen and c not in out), reverse=True)[:size - len(chosen)]
        rest = math.prod(free)
        return np.bincount(code).max(initial=0) <= rest and math.prod(self.distinct[c] for c in chosen) * rest >= self.target

    def of_size(self, size: int) -> list[frozenset[int]]:
        """All sets of up to that many columns that tell the rows apart; none of them is found twice."""
        found = []

        def go(chosen: frozenset[int], out: frozenset[int]) -> None:
            code = self.groups(chosen)
            if not self.able(chosen, out, size, code):
                return
            unmet = next((d for d in self.differences if not d & chosen), None)
            if unmet is None:
                if code.max(initial=-1) + 1 == len(self.rows):
                    found.append(chosen)
                    return
                rest = [self.rows[:, c] for c in range(self.rows.shape[1]) if c not in chosen]
                self.differ(np.lexsort((*rest, code)), code)
                unmet = next(d for d in self.differences if not d & chosen)
            if len(chosen) == size:
                return
            gone = out
            for c in sorted(unmet - out):
                go(chosen | {c}, gone)
                gone = gone | {c}

        go(frozenset(), frozenset())
        return found

    def smallest(self) -> list[tuple[int, ...]]:
        for size in range(1, self.rows.shape[1] + 1):
            if found := self.of_size(size):
                return sorted(tuple(sorted(x)) for x in found)
        return []


def smallest_combos(df: DataFrame, distinct: dict[str, int], target: int, sample_rows: int = SAMPLE_ROWS) -> list[list[str]]:
    """All combinations of the fewest columns with as many distinct rows (target) as all columns together, as many as there are.

    Combinations are searched on a sample of bounded size and counted on the whole table. One that is not unique there gives rows it leaves
    together; these join the sample, which rules it and many others out. What is returned has been counted, and what is not has two
    rows of the table against it."""
    names = list(distinct)
    slices = max(1, target // sample_rows)
    part = df.select(*[col(n) for n in names]).where(F.pmod(F.xxhash64(*[col(n) for n in names]), F.lit(slices)) == 0)
    numbers: list[dict] = [{} for _ in names]

    def coded(rows: list[Row]) -> np.ndarray:
        out = [[known.setdefault(v, len(known)) for known, v in zip(numbers, row, strict=True)] for row in rows]
        return np.unique(np.array(out, np.int64).reshape(-1, len(names)), axis=0)

    search = Search(coded(part.limit(2 * sample_rows).collect()), list(distinct.values()), target)
    counted: dict[tuple[int, ...], int] = {}
    while True:
        found = search.smallest()
        fresh = [c for c in found if c not in counted][:COUNTED]
        if not fresh:
            return [[names[i] for i in c] for c in found]
        results = dict(zip(fresh, together(*[lambda c=c: count_combo(df, [names[i] for i in c]) for c in fresh]), strict=True))
        counted |= {c: d for c, (d, _) in results.items()}
        failed = [c for c in fresh if counted[c] < target]
        for rows in together(*[lambda c=c: left_together(df, names, [names[i] for i in c], results[c][1]) for c in failed]):
            search.add(coded(rows))


def left_together(df: DataFrame, names: list[str], combo: list[str], marks: list[int] | None = None, groups: int = 50) -> list[Row]:
    """Rows that differ and agree on the combination: two of each of some groups. marks: hashes of combinations on several rows, from
    count_combo; all groups are looked at only without them, or if the rows of those are all equal."""
    if marks == []:
        return []
    rows = df.select(F.struct(*[col(n) for n in names]).alias("row"))
    keys = [F.col("row")[c].alias(f"key{i}") for i, c in enumerate(combo)]

    def two_of_each(some: DataFrame) -> list[Row]:
        pairs = some.groupBy(*keys).agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first <> last").limit(groups)
        return [r["row"] for r in pairs.select(F.explode(F.array("first", "last")).alias("row")).collect()]

    if marks is None:
        return two_of_each(rows)
    few = df.where(F.xxhash64(*[col(c) for c in combo]).isin(marks)).select(F.struct(*[col(n) for n in names]).alias("row"))
    return two_of_each(few) or two_of_each(rows)


def find_grain(df: DataFrame, infos: list[dict], most: int | None = None, order: list[str] | None = None) -> list[dict]:
    """[{combo, distinct_rows, dup_rows, near}]: single keys from the profile, else all unique combinations of the fewest
    columns, or the first `most` of them; if nothing is unique, the smallest combination that tells the most rows apart, when
    at most one row in a thousand is a duplicate. Combinations come in the order of their columns; `order` fixes it where distinct counts,
    which change as a table grows, should not."""
    rows = infos[0]["row_count"] if infos else 0
    keys = [i["column_name"] for i in infos if "candidate_pk" in i["flags"]]
    if keys:
        return [{"combo": [k], "distinct_rows": rows, "dup_rows": 0, "near": False} for k in keys]
    distinct = {i["column_name"]: i["distinct_count"] for i in grain_candidates(infos, order)}
    if len(distinct) < 2 or math.prod(distinct.values()) < NEARLY * rows:
        return []
    # no combination tells more rows apart than all candidates together
    target = count_combos(df, [list(distinct)])[0]
    if target < NEARLY * rows:
        return []
    found = [{"combo": c, "distinct_rows": target, "dup_rows": rows - target, "near": target < rows}
             for c in smallest_combos(df, distinct, target)]
    return found[:most] if target == rows else found[:1]


GRAIN_SCHEMA = ("schema_name string, table_name string, rank int, combo array<string>, distinct_rows bigint, "
                "dup_rows bigint, near boolean")


def grain(df: DataFrame, profiled: DataFrame, schema: str, table: str, most: int | None = None, order: list[str] | None = None) -> DataFrame:
    """The grain of one table as rows, best combination first; all of them, or the first `most`."""
    found = find_grain(df, column_infos(profiled, schema, table), most, order)
    rows = [(schema, table, i, g["combo"], g["distinct_rows"], g["dup_rows"], g["near"])
            for i, g in enumerate(found, start=1)]
    return df.sparkSession.createDataFrame(rows, GRAIN_SCHEMA)


def key_check(df: DataFrame, columns: list[str], examples: int = 10) -> tuple[DataFrame, DataFrame]:
    """Is this column set unique? (rows, distinct combinations without nulls, rows with nulls), duplicate examples."""
    columns = list(dict.fromkeys(columns))
    any_null = F.lit(False)
    for c in columns:
        any_null = any_null | col(c).isNull()
    summary = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(*[col(c) for c in columns]).alias("distinct_rows"),
        F.count_if(any_null).alias("rows_with_nulls"))
    summary = summary.withColumn(
        "is_unique", (F.col("rows") == F.col("distinct_rows")) & (F.col("rows_with_nulls") == 0))
    repeated = df.where(~any_null).groupBy(*[col(c) for c in columns]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return summary, repeated.orderBy(F.desc("n"), *[col(c) for c in columns]).limit(examples)
