"""The whole analysis of a set of tables: profile, links, grain, time, dependencies, codes, optional columns, rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.operators import codes, dependencies, grain, optional, profile, relate, rules, time_coverage
from stratalens.operators.profile import Counted, count_values
from stratalens.operators.value_freq import Tables, union_all
from stratalens.staging import held, small_tasks, stage, together
from stratalens.types import split_name

KINDS = {"grain", "time", "deps", "codes", "optional"}


@dataclass
class Analysis:
    """All results as DataFrames; errors lists the tables a step failed on."""

    counted: Counted
    columns: DataFrame
    tables: DataFrame
    relationships: DataFrame
    grains: DataFrame | None = None
    times: DataFrame | None = None
    dependencies: DataFrame | None = None
    codes: DataFrame | None = None
    fills: DataFrame | None = None
    rules: DataFrame | None = None
    errors: list[tuple[str, str, str]] = field(default_factory=list)


FILL_SCHEMA = ("column_name string, by_column string, when_values array<string>, precision double, coverage double, "
               "filled_rows bigint, rows_when bigint, sentence string")


def fill_rules(df: DataFrame, infos: list[dict]) -> DataFrame:
    names, explainers = optional.optional_columns(infos), optional.explaining_columns(infos)
    if not names or not explainers:
        return df.sparkSession.createDataFrame([], FILL_SCHEMA)
    return optional.conditional_fill(held(optional.fill_by_code(df, names, explainers)))


def table_insights(df: DataFrame, profiled: DataFrame, schema: str, table: str, only: set[str]) -> dict[str, DataFrame]:
    """Grain, time coverage, dependencies and fill rules of one table, each a few rows."""
    infos = grain.column_infos(profiled, schema, table)
    named = lambda part: part.select(F.lit(schema).alias("schema_name"), F.lit(table).alias("table_name"), "*")
    out = {}
    if "grain" in only:
        out["grains"] = grain.grain(df, profiled, schema, table)
    if "time" in only:
        out["times"] = held(time_coverage.time_coverage(df, infos, schema, table))
    if "deps" in only:
        out["dependencies"] = held(named(dependencies.dependencies(df, infos)))
    if "optional" in only:
        out["fills"] = held(named(fill_rules(df, infos)))
    return out


@small_tasks
def analyse(tables: Tables, only: set[str] | None = None, deep: bool = False) -> Analysis:
    """Profile and relate all tables together, then look into each table. One table that fails does not stop the rest;
    rows never pass through the driver, only per-column results do."""
    only = KINDS if only is None else only
    counted = count_values(tables)
    profiled = profile.profile(tables, counted=counted)
    def insights(name: str) -> dict[str, DataFrame] | tuple[str, str, str]:
        try:
            return table_insights(tables[name], profiled, *split_name(name), only)
        except Exception as problem:  # noqa: BLE001 - reported per table
            return name, "insights", (str(problem) or type(problem).__name__).splitlines()[0]

    links, *each = together(lambda: relate.discover_relationships(counted.freq, profiled, deep=deep),
                            *[lambda n=name: insights(n) for name in tables])
    result = Analysis(counted, profiled, profile.table_profile(profiled), links)
    found: dict[str, list[DataFrame]] = {}
    for parts in each:
        if isinstance(parts, tuple):
            result.errors.append(parts)
            continue
        for kind, part in parts.items():
            found.setdefault(kind, []).append(part)
    for kind, parts in found.items():
        setattr(result, kind, union_all(parts))
    if "codes" in only:
        result.codes = stage(codes.code_values(profiled, counted.freq), "codes")
    if only == KINDS and not result.errors:
        result.rules = stage(rules.suggest_rules(profiled, result.codes, result.times, result.grains, links, result.fills),
                             "rules")
    return result
