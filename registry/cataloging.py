"""Catalog, search, annotations, snapshots, sources, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from registry.core import SCHEMA, query, table, tables, union_sql, view, with_views
from registry.linking import LINKS, NAMES, _cardinality_sql
from stratalens.operators import catalog as K
from stratalens.operators import export as X
from stratalens.operators import grain as G
from stratalens.operators.profile import count_values, profile, table_profile
from stratalens.operators.relate import discover_relationships
from stratalens.plans import pipeline
from stratalens.plans.analysis import analyse
from stratalens.plans.store import Store
from stratalens.sources import loading, readers, sampling
from stratalens.staging import shared_folder, stage

_CSV_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, CAST(o_orderdate AS DATE) AS o_day"
_ORDERS = f"SELECT {_CSV_COLUMNS} FROM orders"


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- sources
@query("read_parquet", "SELECT o_orderpriority, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def read_parquet(spark, sf):
    """A partitioned copy of a table read back: the folder names become a column again."""
    folder = _folder(spark)
    table(spark, sf, "orders").write.partitionBy("o_orderpriority").parquet(folder)
    df = readers.read(spark, "parquet", [folder])
    return df.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys"))


def _written(spark, sf, fmt, **options):
    folder = _folder(spark)
    view = table(spark, sf, "orders").selectExpr(*[c.strip() for c in _CSV_COLUMNS.split(",")])
    view.write.options(**options).format(fmt).save(folder)
    return folder


@query("read_csv", _ORDERS)
def read_csv(spark, sf):
    return readers.read(spark, "csv", [_written(spark, sf, "csv", header=True)])


@query("read_csv_text", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, 'string' AS kind FROM orders")
def read_csv_text(spark, sf):
    """Everything as text."""
    df = readers.read(spark, "csv", [_written(spark, sf, "csv", header=True)], {"all_text": True})
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("keys"), F.max(F.typeof("o_orderkey")).alias("kind"))


@query("read_json", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS o_day FROM orders")
def read_json(spark, sf):
    return readers.read(spark, "json", [_written(spark, sf, "json")])


@query("custom_reader", _ORDERS)
def custom_reader(spark, sf):
    """A pipe-delimited format registered as a reader of its own."""
    readers.register_reader("pipes", [".psv"], readers.read_pipe_delimited)
    return readers.read(spark, "pipes", [_written(spark, sf, "csv", header=True, sep="|")])


_LOADED = ["nation", "region", "orders", "part"]


def _landing(spark, sf) -> str:
    """A folder as exported by several systems: two folders of part files, one of them partitioned, and one folder with
    numbered chunks."""
    folder = _folder(spark)
    table(spark, sf, "orders").write.partitionBy("o_orderstatus").parquet(f"{folder}/orders")
    table(spark, sf, "part").write.option("header", True).csv(f"{folder}/part")
    table(spark, sf, "nation").write.json(f"{folder}/nation")
    table(spark, sf, "region").write.parquet(f"{folder}/region")
    return folder


@query("discover_tables", union_sql([f"SELECT '{t}' AS table_name, '{f}' AS format FROM {t} HAVING count(*) > 0" for t, f in [
    ("orders", "parquet"), ("part", "csv"), ("nation", "json"), ("region", "parquet")]]))
def discover_tables(spark, sf):
    found = loading.discover_tables(spark, _landing(spark, sf))
    return spark.createDataFrame([(f.table, f.format) for f in found], "table_name string, format string")


@query("load_tables", union_sql([
    f"SELECT '{t}' AS table_name, '{f}' AS format, count(*) AS row_count, {len(SCHEMA[t].split())}::INTEGER AS column_count FROM {t}" for t, f in [
        ("orders", "parquet"), ("part", "csv"), ("nation", "json"), ("region", "parquet")]]))
def load_tables(spark, sf):
    found = loading.discover_tables(spark, _landing(spark, sf))
    _, log = loading.load_tables(spark, found, "erp", _folder(spark))
    return log.select("table_name", "format", "row_count", "column_count")


@query("load_append", "SELECT 'nation' AS table_name, 2 * count(*) AS row_count FROM nation")
def load_append(spark, sf):
    """The same files loaded twice: the second load adds its rows by column name."""
    folder, target = _folder(spark), _folder(spark)
    table(spark, sf, "nation").write.parquet(f"{folder}/nation")
    found = loading.discover_tables(spark, folder)
    loading.load_tables(spark, found, "erp", target)
    return loading.load_tables(spark, found, "erp", target, mode="append")[1].select("table_name", "row_count")


@query("materialise_sample", """
    SELECT 'whole' AS mode, count(*) AS cached_rows, count(*) AS total_rows, TRUE AS complete FROM orders
    UNION ALL SELECT 'first', CAST(ceil(count(*) / 2) AS BIGINT), count(*), FALSE FROM orders
    UNION ALL SELECT 'filter', count(*) FILTER (WHERE o_orderstatus = 'F'), count(*), FALSE FROM orders
    UNION ALL SELECT 'random', CAST(ceil(count(*) / 2) AS BIGINT), count(*), FALSE FROM orders""")
def materialise_sample(spark, sf):
    df = table(spark, sf, "orders")
    half = -(-df.count() // 2)
    made = [(mode, sampling.materialise_sample(df, _folder(spark), **kw)[1]) for mode, kw in {
        "whole": {"rows": 10 ** 12}, "first": {"rows": half, "mode": "first"}, "random": {"rows": half},
        "filter": {"mode": "filter", "where": "o_orderstatus = 'F'"}}.items()]
    return spark.createDataFrame([(m, i["cached_rows"], i["total_rows"], i["complete"]) for m, i in made],
                                 "mode string, cached_rows bigint, total_rows bigint, complete boolean")


# ---------------------------------------------------------------- catalog built from the part table: a column per part
def _erp_catalog(spark, sf):
    return view(spark, sf, "snapshot_old").select(
        F.lit("erp").alias("schema_name"), "table_name", "column_name", F.monotonically_increasing_id().alias("ordinal"), "data_type")


def _erp_full(spark, sf):
    comments = view(spark, sf, "snapshot_old").select(F.lit("erp").alias("schema_name"), "table_name", "column_name", "comment")
    notes = view(spark, sf, "annotations").withColumn("updated_at", F.lit(None).cast("timestamp"))
    return K.build_catalog(_erp_catalog(spark, sf), comments, annotations=notes.drop("version"))


@query("import_comments", with_views("snapshot_old") + """
    SELECT table_name, column_name, p.p_type AS comment FROM snapshot_old s JOIN part p
      ON s.column_name = replace(p.p_name, ' ', '_') || '_' || CAST(p.p_partkey AS STRING) AND s.table_name = lower(replace(p.p_brand, '#', '_'))""")
def import_comments(spark, sf):
    """Comments whose table names are written differently, from a file, matched to the catalog."""
    folder = _folder(spark)
    table(spark, sf, "part").select(
        F.col("p_brand").alias("TABLE_NAME"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string")).alias("column_name"),
        F.col("p_type").alias("comment")).write.option("header", True).csv(folder)
    catalog = _erp_catalog(spark, sf)
    found = K.import_comments(readers.read(spark, "csv", [folder], {"all_text": True}), catalog)
    return catalog.join(found, ["schema_name", "table_name", "column_name"]).select("table_name", "column_name", "comment")


@query("build_catalog", with_views("snapshot_old", "annotations") + """
    SELECT s.table_name, s.column_name, s.data_type, s.comment, a.cdm_entity, a.notes FROM snapshot_old s
    LEFT JOIN annotations a ON a.table_name = s.table_name AND a.column_name = s.column_name""")
def build_catalog(spark, sf):
    return _erp_full(spark, sf).select("table_name", "column_name", "data_type", "comment", "cdm_entity", "notes")


_PLAIN = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"


@query("catalog_search", with_views("snapshot_old") + f"""
    SELECT table_name, column_name, CASE WHEN n = 'redwidget1' THEN 100.0::DOUBLE WHEN starts_with(n, 'redwidget1') THEN 95.0 ELSE 90.0 - least(10.0, (length(n) - 10) / 4) END AS score
    FROM (SELECT *, {_PLAIN.format('column_name')} AS n FROM snapshot_old) WHERE contains(n, 'redwidget1')""")
def catalog_search(spark, sf):
    """Columns whose names contain a term, ignoring case, spaces and underscores."""
    return K.catalog_search(_erp_full(spark, sf), "Red Widget 1", match="contains").select("table_name", "column_name", "score")


@query("catalog_search_exact", with_views("snapshot_old") + f"""
    SELECT table_name, column_name, 100.0::DOUBLE AS score FROM snapshot_old WHERE {_PLAIN.format('column_name')} = 'redwidget1'""")
def catalog_search_exact(spark, sf):
    return K.catalog_search(_erp_full(spark, sf), "RED_widget 1", match="exact").select("table_name", "column_name", "score")


@query("catalog_search_wildcard", with_views("snapshot_old") + """
    SELECT table_name, column_name, 100.0::DOUBLE AS score FROM snapshot_old WHERE regexp_matches(lower(column_name), '^red_.*_1.$')""")
def catalog_search_wildcard(spark, sf):
    return K.catalog_search(_erp_full(spark, sf), "red_*_1?").select("table_name", "column_name", "score")


@query("catalog_search_fuzzy")
def catalog_search_fuzzy(spark, sf):
    """A misspelt term."""
    return K.catalog_search(_erp_full(spark, sf), "red wigdet 17")


@query("schema_scope", with_views("snapshot_old") + "SELECT table_name, count(*) AS columns FROM snapshot_old WHERE table_name IN ('brand_1', 'brand_2') GROUP BY 1")
def schema_scope(spark, sf):
    """Each brand as a schema of its own, restricted to two of them."""
    catalog = _erp_catalog(spark, sf).withColumn("schema_name", F.col("table_name"))
    return K.schema_scope(catalog, {"brand_1", "brand_2"}).groupBy("table_name").agg(F.count(F.lit(1)).alias("columns"))


_STATS = ["nation", "customer", "orders"]


@query("catalog_stats", f"""
    SELECT 'main' AS schema_name, 3::BIGINT AS tables, {sum(len(SCHEMA[t].split()) for t in _STATS)}::BIGINT AS columns, 3::BIGINT AS profiled, 2::BIGINT AS links,
           CAST(sum(n) AS BIGINT) AS rows FROM ({union_sql([f'SELECT count(*) AS n FROM {t}' for t in _STATS])})""")
def catalog_stats(spark, sf):
    named = tables(spark, sf, *_STATS)
    counted = count_values(named)
    p = profile(named, counted=counted)
    return K.catalog_stats(K.build_catalog(counted.columns, profiled=p), discover_relationships(counted.freq, p))


@query("export_catalog", union_sql([
    f"""SELECT '{t}' AS table_name, '{c}' AS column_name, {i}::INTEGER AS ordinal, round(100.0 * (count(*) - count({c})) / count(*), 2) AS null_pct,
        count(DISTINCT {c}) AS distinct_count, CAST(min({c}) AS VARCHAR) AS min_val, CAST(max({c}) AS VARCHAR) AS max_val,
        CASE WHEN count(DISTINCT {c}) = count(*) THEN '' ELSE (SELECT string_agg(v || ' (' || n || ')', '; ' ORDER BY n DESC, v) FROM (
            SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {t} GROUP BY 1 ORDER BY n DESC, v LIMIT 5)) END AS top_values FROM {t}"""
    for t in _STATS for i, c in enumerate([x.split(":")[0] for x in SCHEMA[t].split()], 1)]))
def export_catalog(spark, sf):
    named = tables(spark, sf, *_STATS)
    counted = count_values(named)
    p = profile(named, counted=counted)
    out = X.export_catalog(K.build_catalog(counted.columns, profiled=p), p)
    return out.select("table_name", "column_name", "ordinal", "null_pct", "distinct_count", "min_val", "max_val", "top_values")


@query("upsert_annotations", with_views("annotations") + """
    SELECT table_name, column_name, p || ', ' || lower(p) AS tags, CASE WHEN version > 40 THEN 'Item v2' ELSE '' END AS cdm_entity FROM (
      SELECT *, split_part(tags, ',', 1) AS p FROM annotations) WHERE version <> 9""")
def upsert_annotations(spark, sf):
    """Tags de-duplicated, newer entries replace older ones, entries left empty are deleted."""
    old = view(spark, sf, "annotations").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    renamed = old.where("version > 40").withColumn("cdm_entity", F.lit("Item v2"))
    emptied = old.where("version = 9").withColumns({"tags": F.lit(""), "notes": F.lit(" ")})
    changes = renamed.unionByName(emptied).withColumn("updated_at", F.lit("2024-02-01").cast("timestamp"))
    return K.upsert_annotations(old, changes).select("table_name", "column_name", "tags", "cdm_entity")


def _annotated(spark, sf):
    return view(spark, sf, "annotations").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp")).drop("version")


@query("orphan_annotations", with_views("annotations", "snapshot_new") + """
    SELECT table_name, column_name, CASE WHEN table_name IN (SELECT table_name FROM snapshot_new) THEN 'column no longer exists'
           ELSE 'table no longer in the remote schema' END AS reason FROM annotations a
    WHERE NOT EXISTS (SELECT 1 FROM snapshot_new s WHERE s.table_name = a.table_name AND s.column_name = a.column_name)""")
def orphan_annotations(spark, sf):
    catalog = view(spark, sf, "snapshot_new").select(F.lit("erp").alias("schema_name"), "table_name", "column_name")
    return K.orphan_annotations(_annotated(spark, sf), catalog, {"erp"}).select("table_name", "column_name", "reason")


@query("suggest_remaps")
def suggest_remaps(spark, sf):
    """New names for annotations whose columns were renamed."""
    catalog = view(spark, sf, "snapshot_new").select(F.lit("erp").alias("schema_name"), "table_name", "column_name")
    notes = _annotated(spark, sf)
    return K.suggest_remaps(stage(K.orphan_annotations(notes, catalog, {"erp"}), "orphans"), notes, catalog)


@query("remap_annotations", with_views("annotations") + """
    SELECT table_name, CASE WHEN version = 12 THEN upper(column_name) ELSE column_name END AS column_name, notes FROM annotations""")
def remap_annotations(spark, sf):
    """Annotations of renamed columns moved; moves onto annotated columns are refused."""
    notes = view(spark, sf, "annotations").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    renamed = notes.where("version = 12").select("schema_name", "table_name", "column_name", F.lit(None).cast("string").alias("new_table"),
                                                 F.upper("column_name").alias("new_column"))
    refused = notes.where("version = 13").select("schema_name", "table_name", "column_name", F.lit(None).cast("string").alias("new_table"),
                                                 F.col("column_name").alias("new_column"))
    moves = renamed.unionByName(refused).withColumn("moved_at", F.lit("2024-02-01").cast("timestamp"))
    return K.remap_annotations(notes.drop("version"), moves).select("table_name", "column_name", "notes")


_DIFF = with_views("snapshot_old", "snapshot_new").rstrip() + """,
    o AS (SELECT table_name, count(*) AS n, max(table_comment) AS c, bool_or(dropped) AS dropped FROM snapshot_old GROUP BY 1),
    w AS (SELECT table_name, count(*) AS n, max(table_comment) AS c FROM snapshot_new GROUP BY 1),
    kept AS (SELECT table_name FROM o JOIN w USING (table_name)),
    col AS (SELECT coalesce(a.table_name, b.table_name) AS table_name, a.column_name AS oc, b.column_name AS nc, a.data_type AS ot, b.data_type AS nt, a.comment AS om, b.comment AS nm
            FROM (SELECT * FROM snapshot_old WHERE table_name IN (FROM kept)) a
            FULL JOIN (SELECT * FROM snapshot_new WHERE table_name IN (FROM kept)) b ON a.table_name = b.table_name AND lower(a.column_name) = lower(b.column_name))"""


@query("schema_diff", _DIFF + """
    SELECT 'table_added' AS change, table_name, NULL AS column_name, NULL AS old_value, n || CASE WHEN n = 1 THEN ' column' ELSE ' columns' END AS new_value FROM w WHERE table_name NOT IN (SELECT table_name FROM o)
    UNION ALL SELECT 'table_dropped', table_name, NULL, NULL, NULL FROM o WHERE table_name NOT IN (SELECT table_name FROM w) AND NOT dropped
    UNION ALL SELECT 'table_restored', table_name, NULL, NULL, NULL FROM o WHERE table_name IN (FROM kept) AND dropped
    UNION ALL SELECT 'table_comment_changed', table_name, NULL, o.c, w.c FROM o JOIN w USING (table_name) WHERE o.c <> w.c
    UNION ALL SELECT 'column_added', table_name, nc, NULL, nt FROM col WHERE oc IS NULL
    UNION ALL SELECT 'column_dropped', table_name, oc, ot, NULL FROM col WHERE nc IS NULL
    UNION ALL SELECT 'type_changed', table_name, nc, ot, nt FROM col WHERE ot <> nt
    UNION ALL SELECT 'comment_changed', table_name, nc, om, nm FROM col WHERE om <> nm""")
def schema_diff(spark, sf):
    return K.schema_diff(view(spark, sf, "snapshot_old"), view(spark, sf, "snapshot_new"))


@query("apply_snapshot", with_views("snapshot_old", "snapshot_new") + """
    SELECT table_name, column_name, data_type, FALSE AS dropped FROM snapshot_new
    UNION ALL SELECT table_name, column_name, data_type, TRUE FROM snapshot_old WHERE table_name NOT IN (SELECT table_name FROM snapshot_new)""")
def apply_snapshot(spark, sf):
    new = K.apply_snapshot(view(spark, sf, "snapshot_old"), view(spark, sf, "snapshot_new"))
    return new.select("table_name", "column_name", "data_type", "dropped")


@query("stale_profiles", with_views("snapshot_old", "snapshot_new") + """
    SELECT DISTINCT table_name, TRUE AS stale FROM snapshot_old""")
def stale_profiles(spark, sf):
    """Every brand has changed columns, so every profile is stale."""
    old, new = view(spark, sf, "snapshot_old"), view(spark, sf, "snapshot_new")
    profiles = old.select("table_name").distinct()
    return K.stale_profiles(profiles, K.schema_diff(old, new)).select("table_name", "stale")


@query("data_freshness", """
    SELECT 'orders' AS table_name, count(*) AS stored_rows, count(*) AS current_rows, FALSE AS is_stale FROM orders
    UNION ALL SELECT 'customer', count(*), count(*), TRUE FROM customer
    UNION ALL SELECT 'nation', count(*), count(*) - 1, TRUE FROM nation
    UNION ALL SELECT 'supplier', count(*), count(*), TRUE FROM supplier""")
def data_freshness(spark, sf):
    """Content versions: the same rows in another order, one changed value, one missing row, one value moved to another column."""
    before = tables(spark, sf, "orders", "customer", "nation", "supplier")
    moved = before["supplier"].withColumn("s_nationkey", F.col("s_suppkey")).withColumn("none", F.lit(None).cast("bigint"))
    before["supplier"] = moved
    customer = before["customer"].withColumn("c_acctbal", F.when(F.col("c_custkey") == 7, F.lit(0.01)).otherwise(F.col("c_acctbal")))
    after = {"orders": before["orders"].orderBy(F.desc("o_orderdate")), "customer": customer, "nation": before["nation"].where("n_nationkey <> 3"),
             "supplier": moved.withColumns({"s_nationkey": F.col("none"), "none": F.col("s_nationkey")})}
    return K.data_freshness(stage(K.content_versions(before), "versions"), K.content_versions(after)).drop("schema_name")


@query("incremental_targets", with_views("snapshot_old", "snapshot_new") + """
    SELECT table_name, CASE WHEN table_name NOT IN (SELECT table_name FROM snapshot_old) THEN 'new' WHEN n > 70 THEN 'stale' ELSE 'insights' END AS reason
    FROM (SELECT table_name, (SELECT count(*) FROM snapshot_old o WHERE o.table_name = w.table_name) AS n FROM snapshot_new w GROUP BY 1) WHERE n = 0 OR n > 70 OR n % 2 = 0""")
def incremental_targets(spark, sf):
    profiles = view(spark, sf, "snapshot_old").groupBy("table_name").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("erp").alias("schema_name"), "table_name", F.lit("2024-02-01").cast("timestamp").alias("profiled_at"), (F.col("n") > 70).alias("stale"),
        F.when(F.col("n") % 2 == 0, F.lit("2024-01-01")).otherwise(F.lit("2024-03-01")).cast("timestamp").alias("insights_at"))
    now = view(spark, sf, "snapshot_new").select(F.lit("erp").alias("schema_name"), "table_name")
    return K.incremental_targets(now, profiles).select("table_name", "reason")


# ---------------------------------------------------------------- models and reports
_ENDS = """CASE WHEN cardinality = 'N:M' THEN 'zero_many' WHEN fk_null_pct = 0 THEN 'one' ELSE 'zero_one' END AS parent_end,
    CASE WHEN cardinality = 'N:M' THEN 'zero_many' WHEN cardinality = '1:1' THEN CASE WHEN parent_no_child_pct > 0 THEN 'zero_one' ELSE 'one' END
         WHEN parent_no_child_pct > 0 THEN 'zero_many' ELSE 'one_many' END AS child_end"""


@query("er_model", f"""
    SELECT to_table AS parent_table, from_table AS child_table, from_column AS label, {_ENDS} FROM ({union_sql([_cardinality_sql(*x[:4]) for x in LINKS])})""")
def er_model(spark, sf):
    named = tables(spark, sf, *NAMES)
    counted = count_values(named)
    links = discover_relationships(counted.freq, profile(named, counted=counted))
    return X.er_links(links).select("parent_table", "child_table", "label", "parent_end", "child_end")


def _analysed(spark, sf):
    return analyse(tables(spark, sf, "nation", "region", "customer", "orders"))


@query("er_mermaid")
def er_mermaid(spark, sf):
    """The entity-relationship model as one Mermaid diagram."""
    a = _analysed(spark, sf)
    links = stage(X.er_links(a.relationships), "links")
    return X.er_mermaid(X.er_entities(links, a.tables, a.grains, a.counted.columns), links)


@query("er_neighbours", """
    SELECT unnest(['customer', 'nation', 'orders', 'region']) AS table_name FROM (SELECT count(*) AS n FROM nation) WHERE n > 0""")
def er_neighbours(spark, sf):
    """Tables within two links of the customers."""
    named = tables(spark, sf, "nation", "region", "customer", "orders")
    counted = count_values(named)
    links = stage(X.er_links(discover_relationships(counted.freq, profile(named, counted=counted))), "links")
    return X.er_neighbours(links, "main", "customer", 2).select("table_name")


@query("export_insights", """
    SELECT 'orders' AS table_name, 'o_orderkey' AS grain, 'o_orderdate' AS primary_date, strftime(min(o_orderdate), '%Y-%m') AS first_month,
           strftime(max(o_orderdate), '%Y-%m') AS last_month, count(DISTINCT date_trunc('month', o_orderdate)) AS months_present FROM orders
    UNION ALL SELECT 'customer', 'c_custkey', NULL, NULL, NULL, NULL FROM customer HAVING count(*) > 0
    UNION ALL SELECT 'nation', 'n_nationkey', NULL, NULL, NULL, NULL FROM nation HAVING count(*) > 0
    UNION ALL SELECT 'region', 'r_regionkey', NULL, NULL, NULL, NULL FROM region HAVING count(*) > 0""")
def export_insights(spark, sf):
    a = _analysed(spark, sf)
    return X.export_insights(a.grains, a.times).select("table_name", "grain", "primary_date", "first_month", "last_month", "months_present")


@query("table_spec")
def table_spec(spark, sf):
    """A Markdown specification per table."""
    a = _analysed(spark, sf)
    catalog = K.build_catalog(a.counted.columns, profiled=a.columns)
    return X.table_spec(catalog, a.columns, a.tables, a.grains, a.times, a.relationships)


@query("export_tables", union_sql([
    f"SELECT '{t}' AS table_name, count(*) AS row_count, {len(SCHEMA[t].split())}::BIGINT AS column_count, '{k}' AS candidate_keys FROM {t}"
    for t, k in [("nation", "n_nationkey, n_name"), ("customer", "c_custkey, c_name"), ("orders", "o_orderkey")]]))
def export_tables(spark, sf):
    named = tables(spark, sf, *_STATS)
    counted = count_values(named)
    p = profile(named, counted=counted)
    return X.export_tables(K.build_catalog(counted.columns, profiled=p), table_profile(p)).select(
        "table_name", "row_count", "column_count", "candidate_keys")


@query("analysis_run")
def analysis_run(spark, sf):
    """Everything at once on several tables: how many results of each kind per table."""
    a = analyse({**tables(spark, sf, "nation", "customer", "orders", "events"), "flat_orders": view(spark, sf, "flat_orders")})
    parts = [(a.columns, "columns"), (a.grains, "grain"), (a.times, "time"), (a.dependencies, "dependencies"), (a.codes, "codes"), (a.rules, "rules")]
    out = None
    for df, kind in parts:
        one = df.groupBy("table_name").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


_FIRST, _CHANGED = ("orders", "customer", "region"), "nation"
_SCHEMA = {"orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
           "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "region": ["r_regionkey", "r_name"],
           "nation": ["n_nationkey", "n_name", "n_regionkey"], "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]}


def _pipeline_sql() -> str:
    """After both runs: a row for each column, its counts, and the version that worked on its table."""
    rows = []
    for t, names in _SCHEMA.items():
        version, where = (1, "") if t in _FIRST else (2, " WHERE n_nationkey <> 3" if t == _CHANGED else "")
        rows += [f"SELECT '{t}' AS table_name, '{c}' AS column_name, {version}::BIGINT AS since, count(*) AS row_count, count(DISTINCT {c}) AS distinct_count FROM {t}{where}" for c in names]
    return union_sql(rows)


def _chain(spark, sf) -> Store:
    """Two runs of the chain: all tables but one, then one of them changed, one gone and one new."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    named = {t: df.select(*_SCHEMA[t]) for t, df in tables(spark, sf, *_FIRST, _CHANGED).items()}
    gone = {"part": table(spark, sf, "part")}
    pipeline.run(store, named | gone)
    changed = {**named, _CHANGED: named[_CHANGED].where("n_nationkey <> 3"), "supplier": table(spark, sf, "supplier").select(*_SCHEMA["supplier"])}
    pipeline.run(store, changed)
    return store


@query("pipeline_run", _pipeline_sql())
def pipeline_run(spark, sf):
    """The chain run twice; the second run works on what has changed."""
    return _chain(spark, sf).read("columns").select("table_name", "column_name", "since", "row_count", "distinct_count")


@query("grain_of_key", "SELECT 'o_orderkey' AS combo, count(*) AS distinct_rows, 0::BIGINT AS dup_rows FROM orders")
def grain_of_key(spark, sf):
    """A table with a single-column key."""
    named = tables(spark, sf, "orders")
    return G.grain(named["orders"], profile(named), "main", "orders").select(F.array_join("combo", "+").alias("combo"), "distinct_rows", "dup_rows")
