"""Every oracle belongs to a query; a few queries run against DuckDB end to end."""

import glob
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check import compare  # noqa: E402


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


@pytest.mark.parametrize("name", ["cardinality", "value_overlap", "top_values", "patterns", "dependency_exceptions", "schema_diff", "score_duplicates",
                                  "compare_attributes", "value_search", "evaluate_rules", "filter_predicate", "breakdown"])
def test_against_duckdb(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, sf)
    cursor = con.execute(entry.oracle_sql()[name])
    assert compare([r.asDict() for r in df.collect()], df.columns, cursor.fetchall(), [c[0] for c in cursor.description]) == "ok"


def test_entry(spark):
    assert entry.entry(spark).count() >= 7
