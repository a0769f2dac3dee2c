"""One chain from files to rules, repeated at will: load, comments, profile, links, insights, rules.

A run compares each table's content with that of the stored version and works on tables that are new, changed, or lack insights; all others
keep their stored results, and their rows are read for the comparison only. Links and rules are worked out again from the stored profiles and
value counts of all tables, since a changed table can change the links of others. Tables that are gone leave the new version.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.operators import catalog, codes, profile, relate, rules
from stratalens.operators.profile import count_values
from stratalens.operators.value_freq import Tables, union_all
from stratalens.plans.analysis import KINDS, table_insights
from stratalens.plans.store import ENTRY, WHOLE, Store
from stratalens.sources.loading import discover_tables, load_tables
from stratalens.staging import held, stage, together
from stratalens.types import column_frame, split_name

STATE = ("schema_name", "table_name", "row_count", "content", "profiled_at", "insights_at")
#: Results of each table; the others, relationships, rules and comments, are of all tables together.
OF_TABLES = ("state", "columns", "counts", "grains", "times", "dependencies", "fills", "codes")


@dataclass
class Run:
    """The version after a run, what it worked on and why, and what failed."""

    version: int
    targets: list[tuple[str, str, str]]
    dropped: list[tuple[str, str]] = field(default_factory=list)
    log: DataFrame | None = None
    errors: list[tuple[str, str, str]] = field(default_factory=list)


def targets_of(store: Store, tables: Tables, entries: list) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """Content of the tables now, and which to work on, with the reason: new, stale or insights."""
    now = stage(catalog.content_versions(tables), "content")
    state = store.read("state", entries)
    if state is None:
        return now, [(r["schema_name"], r["table_name"], "new") for r in now.collect()]
    fresh = catalog.data_freshness(state, now).select("schema_name", "table_name", F.col("is_stale").alias("stale"))
    known = state.join(fresh, ["schema_name", "table_name"])
    found = catalog.incremental_targets(now, known).collect()
    return now, sorted((r["schema_name"], r["table_name"], r["reason"]) for r in found)


def numbered(columns: DataFrame) -> DataFrame:
    """Profile rows with col_id counted over all tables; a few rows for each table of the catalog."""
    return held(columns.drop("col_id", "since").withColumn("col_id", F.row_number().over(Window.orderBy("schema_name", "table_name", "ordinal")) - 1))


def load(spark: SparkSession, folder: str, target: str, schema: str = "main", options: dict | None = None) -> tuple[Tables, DataFrame]:
    """The tables of a folder of files, written as Parquet below target, with the log."""
    return load_tables(spark, discover_tables(spark, folder), schema, target, options=options)


def run(store: Store, tables: Tables, comments: DataFrame | None = None, log: DataFrame | None = None, deep: bool = False) -> Run:
    """Brings the store up to date with the tables; a run without anything to do adds no version.

    comments: rows as import_comments takes them, replacing those of the store."""
    spark, before = store.spark, store.version()
    entries = store.entries(before)
    now, targets = targets_of(store, tables, entries)
    names = {split_name(n): n for n in tables}
    gone = sorted({(e["schema_name"], e["table_name"]) for e in entries} - set(names) - {WHOLE})
    if not targets and not gone and comments is None:
        return Run(before, [], log=log)
    again = [names[s, t] for s, t, why in targets if why != "insights"]
    touched, this = {(s, t) for s, t, _ in targets}, store.new_run()
    kept = [e for e in entries if (e["schema_name"], e["table_name"]) not in touched | set(gone) | {WHOLE}]
    replaced = {split_name(n) for n in again}
    # tables that only lack insights keep their profile and counts
    kept += [e for e in entries if (e["schema_name"], e["table_name"]) in touched - replaced and e["kind"] in ("columns", "counts")]
    version = before + 1
    current = [tuple(e[c] for c in ENTRY) for e in kept]

    def written(kind: str, rows: DataFrame, own: set[tuple[str, str]]) -> None:
        fields = store.write(kind, this, rows, own == {WHOLE})
        current.extend((kind, s, t, this, version, fields) for s, t in sorted(own))

    def stored(kind: str) -> DataFrame | None:
        return store.read(kind, [dict(zip(ENTRY, e, strict=True)) for e in current])

    if again:
        work = {n: tables[n] for n in again}
        counted = count_values(work)
        written("columns", profile.profile(work, counted=counted), replaced)
        ids = column_frame(spark, counted.metas).select("col_id", "schema_name", "table_name", "column_name")
        written("counts", counted.counts.join(F.broadcast(ids), "col_id").drop("col_id"), replaced)
    columns = numbered(stored("columns"))
    ids = F.broadcast(columns.select("schema_name", "table_name", "column_name", "col_id"))
    counts = stored("counts").drop("since").join(ids, ["schema_name", "table_name", "column_name"])
    freq = counts.where("value IS NOT NULL").drop("schema_name", "table_name", "column_name")

    def insights(name: str) -> dict[str, DataFrame] | tuple[str, str, str]:
        try:
            return table_insights(tables[name], columns, *split_name(name), KINDS)
        except Exception as problem:  # noqa: BLE001 - reported, and tried again by the next run
            return name, "insights", (str(problem) or type(problem).__name__).splitlines()[0]

    links, *each = together(lambda: relate.discover_relationships(freq, columns, deep=deep), *[lambda n=names[s, t]: insights(n) for s, t, _ in targets])
    errors = [x for x in each if isinstance(x, tuple)]
    failed = {split_name(name) for name, _, _ in errors}
    parts: dict[str, list[DataFrame]] = {}
    for found in each:
        for kind, part in ({} if isinstance(found, tuple) else found).items():
            parts.setdefault(kind, []).append(part)

    def among(some: set[tuple[str, str]]) -> Column:
        return F.struct("schema_name", "table_name").cast("string").isin([f"{{{s}, {t}}}" for s, t in sorted(some)])

    parts["codes"] = [codes.code_values(columns.where(among(touched)), freq)]
    for kind, found in parts.items():
        written(kind, union_all(found), touched if kind == "codes" else touched - failed)
    state = now.where(among(touched)).withColumn("profiled_at", F.current_timestamp())
    written("state", state.withColumn("insights_at", F.when(~among(failed), F.col("profiled_at"))).select(*STATE), touched)
    written("relationships", links, {WHOLE})
    inputs = [stored(kind) for kind in ("codes", "times", "grains", "fills")]
    if all(x is not None for x in inputs):
        code, time, grain, fill = (x.drop("since") for x in inputs)
        written("rules", rules.suggest_rules(columns, code, time, grain, links, fill), {WHOLE})
    if comments is not None:
        written("comments", catalog.import_comments(comments, columns), {WHOLE})
    else:
        current += [tuple(e[c] for c in ENTRY) for e in entries if e["kind"] == "comments"]
    return Run(store.commit(before, this, current), targets, gone, log, errors)
