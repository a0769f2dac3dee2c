"""The chain from files to rules, run again over a versioned store."""

import pytest
from pyspark.errors import AnalysisException

from stratalens.plans import pipeline
from stratalens.plans.store import ENTRY, Store


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    spark.range(40).selectExpr("id AS city_id", "concat('city ', id) AS city_name").write.parquet(f"{at}/city")
    spark.range(200).selectExpr("id AS person_id", "id % 40 AS city_id", "if(id % 3 = 0, 'A', 'B') AS person_type").write.json(f"{at}/person")
    spark.range(5).selectExpr("id AS code", "'x' AS fixed").write.option("header", True).csv(f"{at}/kind")
    return str(at)


def test_second_run_touches_changed_tables_only(spark, folder, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    tables, log = pipeline.load(spark, folder, str(tmp_path / "loaded"))
    assert set(tables) == {"main.city", "main.person", "main.kind"} and log.where("error IS NULL").count() == 3
    comments = spark.createDataFrame([("CITY", "city_id", "the key"), ("nothing", None, "lost")], "table_name string, column_name string, comment string")
    first = pipeline.run(store, tables, comments, log)
    assert first.version == 1 and {t[1:] for t in first.targets} == {("city", "new"), ("person", "new"), ("kind", "new")} and not first.errors
    links = {(r["from_table"], r["from_column"], r["to_table"]) for r in store.read("relationships").collect()}
    assert ("person", "city_id", "city") in links and store.read("rules").count() > 0 and store.read("comments").count() == 1
    assert pipeline.run(store, tables).version == 1      # nothing to do

    changed = {n: df for n, df in tables.items() if n != "main.kind"}
    changed["main.person"] = tables["main.person"].where("person_id <> 7")
    seen = []
    real = pipeline.profile.profile
    monkeypatch.setattr(pipeline.profile, "profile", lambda work, **more: seen.append(set(work)) or real(work, **more))
    second = pipeline.run(store, changed)
    assert second.version == 2 and second.targets == [("main", "person", "stale")] and second.dropped == [("main", "kind")] and seen == [{"main.person"}]
    columns = {(r["table_name"], r["column_name"]): (r["since"], r["row_count"]) for r in store.read("columns").collect()}
    assert columns["city", "city_id"] == (1, 40) and columns["person", "person_id"] == (2, 199) and ("kind", "code") not in columns
    assert {r["since"] for r in store.read("comments").collect()} == {1} and {r["since"] for r in store.read("relationships").collect()} == {2}
    # the version before is still there, and a writer that started from it can't commit
    assert {r["table_name"] for r in store.read("columns", version=1).collect()} == {"city", "person", "kind"}
    with pytest.raises(AnalysisException):
        store.commit(1, store.new_run(), [tuple(e[c] for c in ENTRY) for e in store.entries(1)])
    assert store.version() == 2


def test_failed_insights_are_tried_again(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    tables = {"a": spark.range(30).selectExpr("id", "id % 3 AS k"), "b": spark.range(20).selectExpr("id", "id % 2 AS m")}
    real = pipeline.table_insights

    def broken(df, profiled, schema, table, only):
        if table == "b":
            raise ValueError("no insight")
        return real(df, profiled, schema, table, only)

    monkeypatch.setattr(pipeline, "table_insights", broken)
    first = pipeline.run(store, tables)
    assert first.errors == [("b", "insights", "no insight")] and first.version == 1
    monkeypatch.setattr(pipeline, "table_insights", real)
    second = pipeline.run(store, tables)
    assert second.targets == [("main", "b", "insights")] and second.version == 2 and not second.errors
    assert {(r["table_name"], r["since"]) for r in store.read("columns").collect()} == {("a", 1), ("b", 1)}
    assert {(e["table_name"], e["since"]) for e in store.entries() if e["kind"] == "grains"} == {("a", 1), ("b", 2)}
