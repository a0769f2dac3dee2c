"""Column dependencies X -> Y (Y is determined by X) and what follows from them: entities, hierarchies, model notes."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.operators.grain import is_measure, is_prose
from stratalens.operators.graph import connected_components
from stratalens.types import KEYISH_NAME, col

# Share of rows that must agree, share of one value above which a column says nothing.
MIN_STRENGTH, TOP_SHARE = 0.98, 0.95
# Slices of the determinant's values, and which of them are looked at together, one after another.
SLICES = 64
PARTS = (range(1), range(1, 8), range(8, SLICES))
NAME_SUFFIX = r"(?i)(_?(id|key|code|no|num|nbr|number|cd|ref|name|nm|desc|description|label))$"

EDGE_SCHEMA = ("determinant string, dependent string, strength double, exceptions bigint, rows_checked bigint, "
               "determinant_distinct bigint, kind string")


def _top_share(info: dict) -> float:
    if info["top_n"] and info["non_null"]:
        return info["top_n"] / info["non_null"]
    return 1.0 / info["distinct_count"] if info["distinct_count"] else 1.0


def dependency_pairs(infos: list[dict]) -> list[tuple[dict, list[dict]]]:
    """(determinant, its candidate dependents) worth testing, from profile rows."""
    tell = {i["column_name"]: i for i in infos if _tells(i)}
    sources = {n for n, i in tell.items() if i["family"] not in ("temporal", "bool") and 2 * i["distinct_count"] <= i["non_null"]}
    goals = {n for n, i in tell.items() if _top_share(i) < TOP_SHARE}
    kept = {x: [tell[y] for y in tell if y in goals - {x} and tell[y]["distinct_count"] <= _room(tell[x]["distinct_count"])] for x in tell if x in sources}
    return [(tell[x], found) for x, found in kept.items() if found]


def _tells(info: dict) -> bool:
    """A column of several values that are neither amounts nor prose."""
    barred = {"all_null", "constant"}.intersection(info["flags"])
    return info["distinct_count"] > 1 and info["family"] != "other" and not (barred or is_prose(info) or is_measure(info))


def _room(values: int) -> int:
    """How many values a column may have that one of so many values could determine, dirt included."""
    return values + max(values, 20)


def pair_agreement(df: DataFrame, pairs: list[tuple[str, list[str]]], part: range = range(1), of: int = 1) -> DataFrame:
    """(determinant, dependent, agreeing, checked): rows that have the most common Y of their X, and rows with an X.

    All pairs in one scan: counts per (pair, X, Y), then the largest count per (pair, X). Both steps combine before
    their shuffle, so a value on a third of the rows is one row per task. A row gives one row for each wanted pair and no other.
    part, of: of so many slices of the X values, those to look at."""
    xs, ys = [x for x, _ in pairs], list(dict.fromkeys(y for _, own in pairs for y in own))
    each = []
    for i, (x, own) in enumerate(pairs):
        value = col(x).cast("string")
        inside = F.pmod(F.xxhash64(value), F.lit(of)).between(part.start, part.stop - 1)
        with_ys = F.array(*[F.struct(F.lit(ys.index(y)).alias("j"), col(y).cast("string").alias("y")) for y in own])
        each.append(F.when(value.isNotNull() & inside, F.struct(F.lit(i).alias("i"), value.alias("x"), with_ys.alias("own"))))
    long = df.select(F.explode(F.array_compact(F.array(*each))).alias("e")).select("e.i", "e.x", F.explode("e.own").alias("o")).select("i", "x", "o.j", "o.y")
    named = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), F.col(at) + 1)
    per_value = long.groupBy("i", "j", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    per_x = per_value.groupBy("i", "j", "x").agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    return per_x.groupBy("i", "j").agg(F.sum("top").alias("agreeing"), F.sum("all").alias("checked")).select(
        named(xs, "i").alias("determinant"), named(ys, "j").alias("dependent"), "agreeing", "checked")


def lasting_pairs(df: DataFrame, pairs: list[tuple[str, list[str]]], filled: dict[str, int], min_strength: float) -> list[tuple[str, str, int, int]]:
    """(determinant, dependent, agreeing, checked) of the pairs that hold, found slice by slice of the X values.

    Exceptions of different X values add up. As soon as a pair has more than it may have in all rows with an X (filled), it leaves, so the large
    slices are counted for few pairs. What goes through the driver is one row a pair."""
    total: dict[tuple[str, str], tuple[int, int]] = {}
    for part in PARTS:
        for r in pair_agreement(df, pairs, part, SLICES).collect():
            agreeing, checked = total.get((r["determinant"], r["dependent"]), (0, 0))
            total[r["determinant"], r["dependent"]] = agreeing + r["agreeing"], checked + r["checked"]

        def able(x: str, y: str) -> bool:
            agreeing, checked = total.get((x, y), (0, 0))
            return checked - agreeing <= (1 - min_strength) * filled[x] * (1 + 1e-9)

        pairs = [(x, own) for x, own in ((x, [y for y in own if able(x, y)]) for x, own in pairs) if own]
        if not pairs:
            return []
    return [(x, y, *total[x, y]) for x, own in pairs for y in own if (x, y) in total and total[x, y][0] / total[x, y][1] >= min_strength]


def dependencies(df: DataFrame, infos: list[dict], min_strength: float = MIN_STRENGTH) -> DataFrame:
    """One row per dependency that holds for at least min_strength of the rows."""
    spark = df.sparkSession
    pairs = dependency_pairs(infos)
    if not pairs:
        return spark.createDataFrame([], EDGE_SCHEMA)
    size = {x["column_name"]: x["distinct_count"] for x, _ in pairs}
    named = [(x["column_name"], [y["column_name"] for y in ys]) for x, ys in pairs]
    found = lasting_pairs(df, named, {x["column_name"]: x["non_null"] for x, _ in pairs}, min_strength)
    rows = [(x, y, agreeing / checked, checked - agreeing, checked, size[x], "exact" if agreeing == checked else "approx") for x, y, agreeing, checked in found]
    return spark.createDataFrame(rows, EDGE_SCHEMA).withColumn("strength", F.round("strength", 5))


def dependency_exceptions(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """Rows whose dependent value is not the usual one of their determinant, with the expected value.

    The expected value is found from counts per (X, Y), so a determinant value with very many rows is combined before
    the shuffle and meets its rows in a join against one row per X."""
    x, y = col(determinant), col(dependent)
    counts = df.where(x.isNotNull()).groupBy(x.alias("_x"), y.alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    # most rows first, then the smallest value, nulls last
    order = F.struct((-F.col("_n")).alias("n"), F.col("_y").isNull().alias("e"), F.col("_y").alias("y"))
    usual = counts.groupBy("_x").agg(F.min(order)["y"].alias(f"expected_{dependent}"))
    joined = df.join(usual, x == F.col("_x")).drop("_x")
    return joined.where(~y.eqNullSafe(F.col(f"expected_{dependent}")))


# ---------------------------------------------------------------- structure of one or many tables' dependencies
def entity_name(name: Column) -> Column:
    """property_code -> Property, room_type_id -> Room type, CustomerId -> Customer."""
    base = F.regexp_replace(name, NAME_SUFFIX, "")
    base = F.when(base == "", name).otherwise(base)
    spaced = F.trim(F.replace(F.regexp_replace(base, r"(?<=[a-z0-9])(?=[A-Z])", " "), F.lit("_"), F.lit(" ")))
    return F.when(spaced == "", name).otherwise(
        F.concat(F.upper(F.left(spaced, F.lit(1))), F.lower(F.substr(spaced, F.lit(2)))))


def drop_dismissed(edges: DataFrame, dismissed: DataFrame | None) -> DataFrame:
    """Edges without those a modeller has hidden: dismissed(determinant, dependent)."""
    if dismissed is None:
        return edges
    return edges.join(dismissed, ["determinant", "dependent"], "left_anti")


def entity_classes(edges: DataFrame, ordinals: DataFrame) -> DataFrame:
    """(column_name, class_id, place): columns that determine each other are spellings of one attribute.

    ordinals: (column_name, ordinal). A class is named by its first member: key-like names first, then column order."""
    back = edges.select(F.col("dependent").alias("determinant"), F.col("determinant").alias("dependent"))
    mutual = edges.select("determinant", "dependent").join(back, ["determinant", "dependent"], "left_semi")
    members = edges.select(F.explode(F.array("determinant", "dependent")).alias("column_name")).distinct()
    parts = connected_components(mutual, "determinant", "dependent").withColumnRenamed("node", "column_name")
    classed = members.join(parts, "column_name", "left").withColumn("component", F.coalesce("component", "column_name"))
    classed = classed.join(ordinals, "column_name", "left")
    order = Window.partitionBy("component").orderBy(
        ~F.col("column_name").rlike(KEYISH_NAME), F.coalesce("ordinal", F.lit(0)), "column_name")
    named = classed.withColumn("class_id", F.first("column_name").over(order)).withColumn("place", F.row_number().over(order))
    return named.select("column_name", "class_id", "place")


def class_edges(edges: DataFrame, classes: DataFrame, dismissed: DataFrame | None = None) -> DataFrame:
    """(from_class, to_class, strength, exceptions, kind): the weakest link between two classes stands for them."""
    ends = _between_classes(edges, classes)
    weakest = F.min(F.struct("strength", "determinant", "dependent", "exceptions", "kind")).alias("w")
    linked = ends.where("from_class <> to_class").groupBy("from_class", "to_class").agg(weakest).select(
        "from_class", "to_class", "w.strength", "w.exceptions", "w.kind")
    if dismissed is not None:
        gone = _between_classes(dismissed, classes).select("from_class", "to_class").distinct()
        linked = linked.join(gone, ["from_class", "to_class"], "left_anti")
    return linked


def _between_classes(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    source = classes.select(F.col("column_name").alias("determinant"), F.col("class_id").alias("from_class"))
    target = classes.select(F.col("column_name").alias("dependent"), F.col("class_id").alias("to_class"))
    return pairs.join(source, "determinant").join(target, "dependent")


def transitive_reduction(links: DataFrame) -> DataFrame:
    """Links A -> C without those that a path A -> B -> C explains."""
    first = links.select("from_class", F.col("to_class").alias("middle"))
    second = links.select(F.col("from_class").alias("middle"), "to_class")
    explained = first.join(second, "middle").where("from_class <> to_class").select("from_class", "to_class").distinct()
    return links.join(explained, ["from_class", "to_class"], "left_anti")


def candidate_entities(classes: DataFrame, reduced: DataFrame, infos: DataFrame,
                       annotations: DataFrame | None = None) -> DataFrame:
    """Classes that determine others or have several spellings, with a suggested name.

    infos: (column_name, distinct_count); annotations: (column_name, cdm_entity) override the name."""
    members = classes.groupBy("class_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "column_name"))), lambda m: m["column_name"]).alias("columns"))
    outs = reduced.groupBy(F.col("from_class").alias("class_id")).agg(
        F.array_sort(F.collect_list("to_class")).alias("determines"))
    joined = members.join(outs, "class_id", "left").withColumn(
        "determines", F.coalesce("determines", F.array().cast("array<string>")))
    joined = joined.where((F.size("determines") > 0) | (F.size("columns") > 1))
    joined = joined.join(infos.select(F.col("column_name").alias("class_id"), "distinct_count"), "class_id", "left")
    given = F.lit(None).cast("string")
    if annotations is not None:
        joined = joined.join(annotations.select(F.col("column_name").alias("class_id"), "cdm_entity"), "class_id", "left")
        given = F.nullif(F.col("cdm_entity"), F.lit(""))
    named = joined.withColumn("suggested", given.isNull()).withColumn("name", F.coalesce(given, entity_name(F.col("class_id"))))
    # a second class with the same suggested name is spelt out
    size = F.size("determines") + F.size("columns")
    order = Window.partitionBy("name").orderBy(F.desc(size), F.desc("distinct_count"), "class_id")
    spelt = F.replace(F.regexp_replace(F.col("class_id"), r"(?<=[a-z0-9])(?=[A-Z])", " "), F.lit("_"), F.lit(" "))
    spelt = F.concat(F.upper(F.left(spelt, F.lit(1))), F.lower(F.substr(spelt, F.lit(2))))
    repeated = (F.row_number().over(order) > 1) & F.col("suggested")
    return named.withColumn("name", F.when(repeated, spelt).otherwise(F.col("name"))).select(
        "class_id", "name", "suggested", "columns", "determines", "distinct_count")


def hierarchies(reduced: DataFrame) -> DataFrame:
    """Longest chains of at least three classes, e.g. nation -> region: (levels array).

    A recursive query over the class links of one table (a handful of rows)."""
    links = reduced.select("from_class", "to_class")
    found = links.sparkSession.sql(
        """
        WITH RECURSIVE walk(levels, last) AS (
          SELECT array(l.from_class, l.to_class), l.to_class FROM {links} l
          WHERE l.from_class NOT IN (SELECT to_class FROM {links})
          UNION ALL
          SELECT array_append(w.levels, l.to_class), l.to_class
          FROM walk w JOIN {links} l ON l.from_class = w.last
          WHERE NOT array_contains(w.levels, l.to_class))
        SELECT levels, last FROM walk
        """, links=links)
    onward = found.join(links, F.col("last") == F.col("from_class")).where(
        ~F.array_contains("levels", F.col("to_class"))).select("levels").distinct()
    ends = found.where(F.size("levels") >= 3).join(onward, "levels", "left_anti").select("levels").distinct()
    return ends.orderBy("levels")


def dirty_dependencies(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Dependencies with exceptions, one per dependent: the determinant with the fewest distinct values explains it."""
    named = edges.join(classes.select(F.col("column_name").alias("determinant"), "class_id"), "determinant")
    order = Window.partitionBy("dependent").orderBy(
        "determinant_distinct", F.col("determinant") != F.col("class_id"), "strength", "determinant")
    first = named.where("kind = 'approx'").withColumn("rank", F.row_number().over(order)).where("rank = 1")
    sentence = F.concat(F.col("dependent"), F.lit(" depends on "), F.col("determinant"), F.lit(" for "),
                        F.format_string("%.1f", 100 * F.col("strength")), F.lit("% of rows ("),
                        F.format_number("exceptions", 0), F.lit(" exception rows)"))
    return first.select("determinant", "dependent", "strength", "exceptions", "rows_checked", sentence.alias("sentence"))


def _normal(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def model_notes(classes: DataFrame, reduced: DataFrame, links: DataFrame, catalog: DataFrame, schema: str,
                table: str) -> DataFrame:
    """(kind, columns, sentence): redundant foreign keys and copies of a referenced table's attributes.

    links: discovered relationships; catalog: (schema_name, table_name, column_name)."""
    mine = links.where((F.col("from_schema") == schema) & (F.col("from_table") == table)).select(
        F.col("from_column").alias("column_name"), "to_schema", "to_table")
    fks = classes.join(mine, "column_name")
    first_fk = fks.groupBy("class_id").agg(F.min(F.struct("place", "column_name", "to_table", "to_schema")).alias("fk"))
    here = first_fk.select(F.col("class_id").alias("from_class"), F.col("fk").alias("a"))
    there = first_fk.select(F.col("class_id").alias("to_class"), F.col("fk").alias("c"))
    redundant = reduced.join(here, "from_class").join(there, "to_class").select(
        F.lit("redundant_fk").alias("kind"), F.array("a.column_name", "c.column_name").alias("columns"),
        F.concat("c.column_name", F.lit(" can be derived through "), "a.column_name", F.lit(" ("), "a.to_table",
                 F.lit(" already implies "), "c.to_table", F.lit(") – a redundant foreign key")).alias("sentence"))
    # attributes of an entity that also exist on the table its key refers to
    attributes = reduced.select(F.col("from_class").alias("class_id"), F.col("to_class").alias("of_class")).join(
        classes.select(F.col("class_id").alias("of_class"), "column_name"), "of_class").select("class_id", "column_name")
    spellings = classes.where("place > 1").select("class_id", "column_name")
    copied = attributes.unionByName(spellings).join(first_fk, "class_id")
    target = catalog.select(F.col("schema_name").alias("s"), F.col("table_name").alias("t"),
                            _normal(F.col("column_name")).alias("target")).distinct()
    copied = copied.join(target, (F.col("fk.to_schema") == F.col("s")) & (F.col("fk.to_table") == F.col("t")) & (
        _normal(F.col("column_name")) == F.col("target")))
    copied = copied.join(mine.select("column_name"), "column_name", "left_anti").join(
        redundant.select(F.col("columns")[1].alias("column_name")), "column_name", "left_anti")
    per_key = copied.groupBy("class_id", "fk").agg(F.array_sort(F.collect_set("column_name")).alias("copies"))
    verb = F.when(F.size("copies") == 1, " is a copy of ").otherwise(" are copies of ")
    denormalised = per_key.select(
        F.lit("denormalised").alias("kind"), F.concat(F.array("fk.column_name"), F.col("copies")).alias("columns"),
        F.concat(F.array_join("copies", ", "), verb, "fk.to_table", F.lit("'s attributes (through "), "fk.column_name",
                 F.lit(") – keep them on "), "fk.to_table").alias("sentence"))
    return redundant.unionByName(denormalised)
