"""Reports: catalog rows, insight rows, quality rules for the tools that run them, table specifications, ER models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.operators.rules import PURVIEW_TYPES

TABLE = ["schema_name", "table_name"]


# ---------------------------------------------------------------- catalog and insights
def _listed(items: str, one) -> Column:
    return F.array_join(F.transform(items, one), "; ")


def hint_text() -> Column:
    """'DATE (100.0% parse; %Y-%m-%d 75%, %d/%m/%Y 25%)' from the columns of a profile row."""
    formats = F.array_join(F.transform("date_formats", lambda f: F.concat(
        f["format"], F.lit(" "), F.format_string("%.0f", f["share"] * 100), F.lit("%"))), ", ")
    tail = F.when(F.size("date_formats") > 0, F.concat(F.lit("; "), formats)).otherwise("")
    return F.when(F.col("hint_type").isNotNull(), F.concat(
        F.col("hint_type"), F.lit(" ("), F.format_string("%.1f", F.col("hint_share") * 100), F.lit("% parse"), tail,
        F.lit(")"))).otherwise("")


def export_catalog(catalog: DataFrame, profiled: DataFrame) -> DataFrame:
    """One report row per column."""
    counted = lambda x: F.concat(x["value"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))
    p = profiled.select(
        *TABLE, "column_name", "min_val", "max_val", "effective_null_pct",
        _listed(F.slice("top_values", 1, 5), counted).alias("top_values"),
        F.coalesce(F.get("patterns", F.lit(0))["shape"], F.lit("")).alias("top_pattern"),
        F.array_join(F.transform("placeholder_values", lambda x: F.concat(x["value"], F.lit(" ×"), x["n"].cast("string"))), ", ")
        .alias("placeholders"), hint_text().alias("type_hint"), F.array_join("flags", ", ").alias("flag_list"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return catalog.join(p, [*TABLE, "column_name"], "left").select(
        *TABLE, "column_name", "ordinal", "data_type", blank("comment"), "null_pct", "distinct_count", "distinct_pct",
        "min_val", "max_val", "top_values", "top_pattern", "effective_null_pct", "placeholders", "type_hint",
        F.col("flag_list").alias("flags"), blank("tags"), blank("cdm_entity"), blank("cdm_attribute"), blank("notes"))


def export_tables(catalog: DataFrame, tables: DataFrame) -> DataFrame:
    """One report row per table; tables: table_profile rows."""
    named = catalog.groupBy(*TABLE).agg(F.max("table_comment").alias("comment"))
    return tables.join(named, TABLE, "left").select(
        *TABLE, "row_count", "column_count", F.array_join("candidate_keys", ", ").alias("candidate_keys"),
        F.coalesce("comment", F.lit("")).alias("comment"))


def grain_text() -> Column:
    return F.concat(F.array_join("combo", " + "), F.when(F.col("dup_rows") > 0, F.concat(
        F.lit(" (except "), F.format_number("dup_rows", 0), F.lit(" duplicate rows)"))).otherwise(""))


def export_insights(grains: DataFrame, times: DataFrame) -> DataFrame:
    """Grain and history per table."""
    first = grains.where("rank = 1").select(*TABLE, grain_text().alias("grain"))
    primary = times.where("is_primary").select(
        *TABLE, F.col("column_name").alias("primary_date"), F.date_format("first_month", "yyyy-MM").alias("first_month"),
        F.date_format("last_month", "yyyy-MM").alias("last_month"), "months_present", "empty_months", "future_rows")
    kinds = times.groupBy(*TABLE).agg(F.array_join(F.array_sort(F.collect_list(
        F.concat("column_name", F.lit(" ("), "kind", F.lit(")")))), ", ").alias("date_columns"))
    return first.join(primary, TABLE, "full").join(kinds, TABLE, "full")


def export_dependencies(edges: DataFrame) -> DataFrame:
    return edges.select("determinant", "dependent", F.round(100 * F.col("strength"), 2).alias("strength_pct"), "exceptions", "kind")


# ---------------------------------------------------------------- quality rules
# The check functions of DQX and the expectation types of Great Expectations.
DQX_FUNCTIONS = {
    "not_null": "is_not_null", "not_empty": "is_not_null_and_not_empty", "unique": "is_unique", "unique_combo": "is_unique",
    "regex": "regex_match", "non_negative": "is_not_less_than", "range": "is_in_range",
    "not_in_future": "is_not_in_future", "valid_date": "is_valid_date", "foreign_key": "foreign_key",
    "filled_when": "is_not_null_and_not_empty",
}
DQX_LISTS = ("is_in_list", "is_not_null_and_is_in_list")
GX_TYPES = {
    "not_null": "expect_column_values_to_not_be_null", "not_empty": "expect_column_values_to_not_be_null",
    "unique": "expect_column_values_to_be_unique", "unique_combo": "expect_compound_columns_to_be_unique",
    "in_list": "expect_column_values_to_be_in_set", "regex": "expect_column_values_to_match_regex",
    "non_negative": "expect_column_values_to_be_between", "range": "expect_column_values_to_be_between",
    "valid_date": "expect_column_values_to_match_strftime_format", "filled_when": "expect_column_values_to_not_be_null",
}
GX_LENGTH = "expect_column_value_lengths_to_be_between"


def _quoted(value: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))


def _in_values(values: str) -> Column:
    return F.array_join(F.transform(values, _quoted), ", ")


def rule_filter(quote: str = '"') -> Column:
    """The condition under which a filled_when rule applies, as SQL."""
    mark = F.lit(quote)
    name = F.concat(mark, F.replace(F.col("by_column"), mark, F.lit(quote * 2)), mark)
    return F.when(F.col("by_column").isNotNull(), F.concat(name, F.lit(" IN ("), _in_values("when_values"), F.lit(")")))


def _by_rule(choices: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for rule, text in choices.items():
        out = F.when(F.col("rule") == rule, text).otherwise(out)
    return out


def export_dqx(rules: DataFrame) -> DataFrame:
    """(schema_name, table_name, check_json): one DQX check per rule."""
    rule, one = F.col("rule"), F.col("columns")[0]
    function = F.when(rule == "in_list", F.when(F.col("nulls_allowed"), DQX_LISTS[0]).otherwise(DQX_LISTS[1])).otherwise(
        _by_rule(DQX_FUNCTIONS))
    many = rule.isin("unique", "unique_combo", "foreign_key")
    only = lambda test, value: F.when(test, value)
    # to_json leaves out arguments that are null
    arguments = F.struct(
        only(~many, one).alias("column"), only(many, F.col("columns")).alias("columns"),
        only(rule == "not_empty", F.lit(True)).alias("trim_strings"), F.col("allowed"), F.col("regex"),
        only(rule == "non_negative", F.lit(0)).alias("limit"),
        only(rule == "range", F.col("min_limit")).alias("min_limit"), only(rule == "range", F.col("max_limit")).alias("max_limit"),
        only(rule == "not_in_future", F.lit(0)).alias("offset"), F.col("date_format"),
        only(rule == "foreign_key", F.array("ref_column")).alias("ref_columns"), F.col("ref_table"))
    name = F.left(F.lower(F.concat(rule, F.lit("_"), F.array_join("columns", "_"))), F.lit(120))
    check = F.struct(F.col("criticality"), name.alias("name"), rule_filter("`").alias("filter"),
                     F.struct(function.alias("function"), arguments.alias("arguments")).alias("check"))
    return rules.select(*TABLE, rule.alias("rule"), F.to_json(check).alias("check_json"))


def dqx_yaml(rules: DataFrame) -> DataFrame:
    """(schema_name, table_name, yaml): the DQX checks of each table as one YAML document. A JSON object is YAML."""
    lines = F.array_sort(F.collect_list(F.concat(F.lit("- "), "check_json")))        # the rules of one table
    return export_dqx(rules).groupBy(*TABLE).agg(F.array_join(lines, "\n").alias("yaml"))


def export_gx(rules: DataFrame) -> DataFrame:
    """(schema_name, table_name, expectation_json): Great Expectations expectations; rules it has no type for are left out."""
    rule, one = F.col("rule"), F.col("columns")[0]
    only = lambda test, value: F.when(test, value)
    combo = rule == "unique_combo"
    kinds = F.when(rule == "not_empty", F.array(F.lit(GX_TYPES["not_empty"]), F.lit(GX_LENGTH))).otherwise(
        F.array(_by_rule(GX_TYPES)))
    typed = rules.withColumn("type", F.explode(kinds)).where("type IS NOT NULL")
    length = F.col("type") == GX_LENGTH
    bounded = rule.isin("non_negative", "range")
    kwargs = F.struct(
        only(~combo, one).alias("column"), only(combo, F.col("columns")).alias("column_list"),
        F.col("allowed").alias("value_set"), F.col("regex"),
        F.when(length, F.lit(1.0)).when(bounded, F.col("min_limit")).alias("min_value"),
        only(rule == "range", F.col("max_limit")).alias("max_value"), F.col("strftime").alias("strftime_format"),
        rule_filter("`").alias("row_condition"), only(rule == "filled_when", F.lit("spark")).alias("condition_parser"))
    severity = F.when(F.col("criticality") == "error", "critical").otherwise("warning")
    expectation = F.struct("type", kwargs.alias("kwargs"), F.struct("reason").alias("meta"), severity.alias("severity"))
    return typed.select(*TABLE, rule.alias("rule"), F.to_json(expectation).alias("expectation_json"))


def gx_suites(rules: DataFrame) -> DataFrame:
    """(schema_name, table_name, suite_json): one expectation suite per table."""
    suite = F.concat(F.lit('{"name": "'), F.concat_ws(".", *TABLE), F.lit('", "expectations": ['),
                     F.array_join(F.array_sort(F.collect_list("expectation_json")), ", "), F.lit("]}"))
    return export_gx(rules).groupBy(*TABLE).agg(suite.alias("suite_json"))


def export_purview(rules: DataFrame) -> DataFrame:
    """One row per rule as keyed into Purview data quality."""
    one, rule = F.col("columns")[0], F.col("rule")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    number = lambda c: F.regexp_replace(F.format_string("%.2f", F.col(c)), r"\.?0+$", "")
    setting = (
        F.when(rule == "not_null", "column must not be empty").when(rule == "not_empty", "column must not be empty or blank")
        .when(rule == "unique", "values must be unique")
        .when(rule == "unique_combo", text("no duplicate rows on ", F.array_join("columns", ", ")))
        .when(rule == "in_list", text(one, " IN (", _in_values("allowed"), ")")).when(rule == "regex", F.col("regex"))
        .when(rule == "non_negative", text(one, " >= 0"))
        .when(rule == "range", text(one, " BETWEEN ", number("min_limit"), " AND ", number("max_limit")))
        .when(rule == "not_in_future", text(one, " <= current_date()"))
        .when(rule == "valid_date", text("date format ", F.col("date_format")))
        .when(rule == "foreign_key", text(one, " found in ", F.col("ref_table"), ".", F.col("ref_column")))
        .when(rule == "filled_when", text(one, " IS NOT NULL when ", rule_filter())))
    return rules.select(
        F.concat_ws(".", *TABLE).alias("table"), F.array_join("columns", ", ").alias("columns"), rule.alias("rule"),
        _by_rule(PURVIEW_TYPES).alias("purview_rule_type"), setting.alias("setting_or_expression"), "criticality",
        F.col("passing_pct").alias("passing_pct_today"), "reason")


def write_rules(rules: DataFrame, folder: str) -> None:
    """Checks, suites and the Purview sheet as files; checks and suites in one folder per table."""
    dqx_yaml(rules).write.mode("overwrite").partitionBy(*TABLE).text(f"{folder}/dqx")
    gx_suites(rules).write.mode("overwrite").partitionBy(*TABLE).text(f"{folder}/gx")
    export_purview(rules).write.mode("overwrite").option("header", True).csv(f"{folder}/purview")


# ---------------------------------------------------------------- ER model
# crow's foot marks of the ends of a link (Mermaid), on the left and on the right.
LEFT_ENDS = {"one": "||", "zero_one": "|o", "one_many": "}|", "zero_many": "}o"}
RIGHT_ENDS = {"one": "||", "zero_one": "o|", "one_many": "|{", "zero_many": "o{"}
MIN_CONFIDENCE = 0.8


def er_links(links: DataFrame, min_confidence: float = MIN_CONFIDENCE, tables: DataFrame | None = None) -> DataFrame:
    """Parent, child, label and the kind of both ends; tables: (schema_name, table_name) that both ends must be among."""
    kept = links.where(F.col("confidence") >= min_confidence)
    if tables is not None:
        for end in ("from", "to"):
            named = tables.select(F.col("schema_name").alias(f"{end}_schema"), F.col("table_name").alias(f"{end}_table"))
            kept = kept.join(named, [f"{end}_schema", f"{end}_table"], "left_semi")
    many, childless = F.col("cardinality") == "N:M", F.coalesce("parent_no_child_pct", F.lit(0.0)) > 0
    mandatory = F.coalesce("fk_null_pct", F.lit(0.0)) == 0
    parent_end = F.when(many, "zero_many").when(mandatory, "one").otherwise("zero_one")
    child_end = (
        F.when(many, "zero_many")
        .when(F.col("cardinality") == "1:1", F.when(childless, "zero_one").otherwise("one"))
        .when(F.col("cardinality") == "1:N", F.when(childless, "zero_many").otherwise("one_many"))
        .otherwise("zero_many"))
    return kept.select(
        F.col("to_schema").alias("parent_schema"), F.col("to_table").alias("parent_table"),
        F.col("from_schema").alias("child_schema"), F.col("from_table").alias("child_table"),
        F.col("from_column").alias("label"), parent_end.alias("parent_end"), child_end.alias("child_end"), "cardinality")


def er_entities(links: DataFrame, tables: DataFrame, grains: DataFrame, catalog: DataFrame) -> DataFrame:
    """(schema_name, table_name, column_name, data_type, key): key and foreign-key columns of the linked tables.

    links: er_links rows; tables: table_profile rows. Without a single-column key the grain is the key."""
    linked = links.select(F.col("parent_schema").alias("schema_name"), F.col("parent_table").alias("table_name")).union(
        links.select("child_schema", "child_table")).distinct()
    keyed = tables.join(linked, TABLE).join(
        grains.where("rank = 1").select(*TABLE, "combo"), TABLE, "left")
    key = F.when(F.size("candidate_keys") > 0, F.slice("candidate_keys", 1, 1)).otherwise(
        F.coalesce("combo", F.array().cast("array<string>")))
    pk = keyed.select(*TABLE, F.explode(key).alias("column_name"), F.lit("PK").alias("key"))
    fk = links.select(F.col("child_schema").alias("schema_name"), F.col("child_table").alias("table_name"),
                      F.col("label").alias("column_name")).distinct().join(
        pk, [*TABLE, "column_name"], "left_anti").withColumn("key", F.lit("FK"))
    types = catalog.select(*TABLE, "column_name", "data_type")
    return pk.unionByName(fk).join(types, [*TABLE, "column_name"])


def er_neighbours(links: DataFrame, schema: str, table: str, hops: int = 1) -> DataFrame:
    """Tables within one or two links of a table, itself included."""
    ends = [F.col(c) for c in ("parent_schema", "parent_table", "child_schema", "child_table")]
    p, c = F.struct(ends[0].alias("s"), ends[1].alias("t")), F.struct(ends[2].alias("s"), ends[3].alias("t"))
    steps = links.select(p.alias("a"), c.alias("b")).union(links.select(c, p)).distinct()
    near = links.sparkSession.createDataFrame([((schema, table),)], "a struct<s:string,t:string>")
    for _ in range(hops):
        near = near.union(near.join(steps, "a").select("b")).distinct()
    return near.select(F.col("a.s").alias("schema_name"), F.col("a.t").alias("table_name"))


def er_mermaid(entities: DataFrame, links: DataFrame) -> DataFrame:
    """(mermaid): the model as one Mermaid diagram; a few lines per table."""
    mark = lambda c: F.regexp_replace(c, "[^0-9A-Za-z_]", "_")
    line = F.concat(F.lit("        "), F.lower(F.regexp_extract("data_type", "[A-Za-z]+", 0)), F.lit(" "),
                    mark(F.col("column_name")), F.lit(" "), F.col("key"))
    ordered = F.array_sort(F.collect_list(F.struct(F.when(F.col("key") == "PK", 0).otherwise(1).alias("o"), line.alias("l"))))
    boxes = entities.groupBy(*TABLE).agg(F.array_join(F.transform(ordered, lambda x: x["l"]), "\n").alias("body")).select(
        F.lit(1).alias("part"), F.concat(F.lit("    "), mark(F.col("table_name")), F.lit(" {\n"), "body", F.lit("\n    }")).alias("text"))

    def end(column: str, marks: dict) -> Column:
        out = F.lit("")
        for kind, sign in marks.items():
            out = F.when(F.col(column) == kind, sign).otherwise(out)
        return out

    arrows = links.select(F.lit(2).alias("part"), F.concat(
        F.lit("    "), mark(F.col("parent_table")), F.lit(" "), end("parent_end", LEFT_ENDS), F.lit("--"),
        end("child_end", RIGHT_ENDS), F.lit(" "), mark(F.col("child_table")), F.lit(' : "'), "label", F.lit('"')).alias("text"))
    lines = F.array_sort(F.collect_list(F.struct("part", "text")))
    return boxes.union(arrows).agg(F.concat(
        F.lit("erDiagram\n"), F.array_join(F.transform(lines, lambda x: x["text"]), "\n"), F.lit("\n")).alias("mermaid"))


# ---------------------------------------------------------------- table specification
def table_spec(catalog: DataFrame, profiled: DataFrame, tables: DataFrame, grains: DataFrame, times: DataFrame,
               links: DataFrame) -> DataFrame:
    """(schema_name, table_name, markdown): one specification per table, a few lines per column and link."""
    cell = lambda c: F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")),
                               F.lit("\n"), F.lit(" "))
    flags = profiled.select(*TABLE, "column_name", F.array_join("flags", ", ").alias("flag_list"))
    row = F.concat(F.lit("| "), F.concat_ws(
        " | ", F.col("ordinal").cast("string"), F.concat(F.lit("`"), "column_name", F.lit("`")), "data_type",
        cell(F.col("null_pct")), cell(F.col("distinct_count")), cell(F.col("flag_list")), cell(F.col("tags")),
        cell(F.concat_ws(".", F.nullif("cdm_entity", F.lit("")), F.nullif("cdm_attribute", F.lit("")))), cell(F.col("comment"))), F.lit(" |"))
    columns = catalog.join(flags, [*TABLE, "column_name"], "left").groupBy(*TABLE).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", row.alias("l")))), lambda x: x["l"]), "\n")
        .alias("column_lines"), F.max("table_comment").alias("table_comment"))
    text = F.concat(F.lit("- `"), "from_table", F.lit("."), "from_column", F.lit("` → `"), "to_table", F.lit("."), "to_column",
                    F.lit("` ("), "cardinality", F.lit(", overlap "), F.col("overlap_pct").cast("string"),
                    F.lit("%, confidence "), F.col("confidence").cast("string"), F.lit(") – "), "summary")
    ends = links.select(F.col("from_schema").alias("schema_name"), F.col("from_table").alias("table_name"), text.alias("l")).union(
        links.select("to_schema", "to_table", text)).distinct()
    relations = ends.groupBy(*TABLE).agg(F.array_join(F.array_sort(F.collect_list("l")), "\n").alias("link_lines"))
    insight = export_insights(grains, times)
    joined = tables.join(columns, TABLE).join(insight, TABLE, "left").join(relations, TABLE, "left")
    optional = lambda test, *parts: F.when(test, F.concat(*parts)).otherwise("")
    months = F.col("months_present").cast("string")
    body = F.concat(
        F.lit("# "), F.concat_ws(".", *TABLE), F.lit("\n\n"),
        optional(F.col("table_comment").isNotNull(), F.col("table_comment"), F.lit("\n\n")),
        F.lit("- Rows: "), F.format_number("row_count", 0), F.lit("\n- Columns: "), F.col("column_count").cast("string"),
        F.lit("\n- Candidate keys: "), F.when(F.size("candidate_keys") > 0, F.array_join("candidate_keys", ", ")).otherwise("—"),
        optional(F.col("grain").isNotNull(), F.lit("\n- Grain: one row per "), F.col("grain")),
        optional(F.col("primary_date").isNotNull(), F.lit("\n- History ("), F.col("primary_date"), F.lit("): "),
                 F.col("first_month"), F.lit(" – "), F.col("last_month"), F.lit(", "), months, F.lit(" months, "),
                 F.col("empty_months").cast("string"), F.lit(" empty")),
        F.lit("\n\n| # | Column | Type | Null % | Distinct | Flags | Tags | CDM attribute | Comment |\n"
              "|---|---|---|---|---|---|---|---|---|\n"), F.col("column_lines"),
        optional(F.col("link_lines").isNotNull(), F.lit("\n\n## Relationships\n\n"), F.col("link_lines")), F.lit("\n"))
    return joined.select(*TABLE, body.alias("markdown"))
