"""How queries are registered, and the input tables and planted views they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The input tables: column and type family.
SCHEMA = {
    "region": "r_regionkey:i r_name:s",
    "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
    "supplier": "s_suppkey:i s_name:s s_nationkey:i s_acctbal:d",
    "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s",
    "lineitem": ("l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d l_tax:d "
                 "l_returnflag:s l_linestatus:s l_shipdate:t"),
    "events": "event_id:i ts:t user_id:i event_type:s value:d props:s",
    "documents": "doc_id:i text:s lang:s source:s n_chars:i",
    "labels": "doc_id:i quality:i toxic:i",
    "conversations": "conv_id:i turn:i role:s text:s",
    "pages": "page_id:i url:s html:s",
}
FAMILIES = {"i": "numeric", "d": "numeric", "s": "string", "t": "temporal"}
STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

# Views with planted truths, in SQL that Spark and DuckDB both run.
VIEWS = {
    "flat_orders": """
        SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderdate, c_custkey, c_mktsegment, n_nationkey,
               CASE WHEN o_orderkey % 100 = 0 THEN upper(n_name) || 'X' ELSE n_name END AS n_name, r_regionkey, r_name
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey""",
    "orders_txt": """
        SELECT o_orderkey, o_orderstatus,
               CASE WHEN o_orderkey % 20 = 1 THEN 'N/A' WHEN o_orderkey % 20 = 2 THEN '-'
                    WHEN o_orderkey % 20 = 3 THEN 'unknown ' WHEN o_orderkey % 20 = 5 THEN ' '
                    WHEN o_orderkey % 20 = 6 THEN NULL
                    WHEN o_orderkey % 4 = 0 THEN substr(CAST(o_orderdate AS STRING), 9, 2) || '/'
                         || substr(CAST(o_orderdate AS STRING), 6, 2) || '/' || substr(CAST(o_orderdate AS STRING), 1, 4)
                    ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END AS order_dt_txt,
               CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS amount_txt,
               lpad(CAST(o_custkey % 1000 AS STRING), 5, '0') AS zip_txt,
               CASE WHEN o_orderstatus = 'F' THEN 'Y' ELSE 'N' END AS flag_txt,
               CAST(o_custkey AS STRING) || '.5' AS rate_txt,
               CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) ELSE DATE '1900-01-01' END AS closed_on,
               CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_custkey + 1 END AS agent_id
        FROM orders""",
    "orders_sparse": """
        SELECT o_orderkey, o_orderstatus, o_orderpriority,
               CASE WHEN o_orderstatus = 'F' THEN 'reason ' || CAST(o_custkey % 7 AS STRING) END AS cancel_reason,
               CASE WHEN o_orderstatus = 'F' THEN 'C' || CAST(o_custkey % 5 AS STRING) END AS cancel_code,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'n/a' WHEN o_custkey % 3 = 0 THEN 'note ' || CAST(o_custkey AS STRING)
                    END AS note_txt
        FROM orders""",
    "lineitem_orphan": """
        SELECT l_orderkey, CASE WHEN l_orderkey % 853 = 0 THEN l_partkey + 99000000 ELSE l_partkey END AS l_partkey,
               CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_suppkey END AS l_suppkey, l_linenumber, l_quantity
        FROM lineitem""",
    "charges": """
        SELECT l_orderkey, l_linenumber,
               CASE WHEN l_orderkey % 250 = 0 THEN -l_extendedprice WHEN l_orderkey % 2003 = 0 THEN l_extendedprice * 100
                    ELSE l_extendedprice END AS amount, l_shipdate
        FROM lineitem""",
    "people": """
        SELECT c_custkey AS person_id,
               CASE c_custkey % 7 WHEN 0 THEN 'Anna' WHEN 1 THEN 'Zoë' WHEN 2 THEN 'Marta' WHEN 3 THEN 'Ugo'
                    WHEN 4 THEN 'Élodie' WHEN 5 THEN 'Ivan' ELSE 'Karim' END AS first_name,
               'Ros' || translate(CAST(c_custkey AS STRING), '0123456789', 'abcdefghij') AS last_name,
               CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 'guest' || CAST(c_custkey AS STRING) || '@example.com' END AS email_address,
               CASE c_custkey % 3 WHEN 0 THEN '+39 06 ' || lpad(CAST(c_custkey AS STRING), 8, '0')
                    WHEN 1 THEN '(06) ' || lpad(CAST(c_custkey AS STRING), 8, '0')
                    ELSE '0039-06' || lpad(CAST(c_custkey AS STRING), 8, '0') END AS mobile_phone,
               CASE WHEN c_custkey % 2 = 0 THEN '1980-' || lpad(CAST(c_custkey % 12 + 1 AS STRING), 2, '0') || '-11'
                    ELSE '11/' || lpad(CAST(c_custkey % 12 + 1 AS STRING), 2, '0') || '/1980' END AS birth_date,
               c_nationkey, c_mktsegment
        FROM customer""",
    "people_dup": """
        SELECT person_id, first_name, last_name, email_address, mobile_phone, birth_date FROM people
        UNION ALL
        SELECT person_id + 90000000, upper(first_name), last_name || 'e', CAST(NULL AS STRING), mobile_phone, birth_date
        FROM people WHERE c_mktsegment = 'BUILDING'""",
    "crm_people": """
        SELECT 'G' || lpad(CAST(person_id AS STRING), 8, '0') AS guest_code, upper(last_name) AS FamilyName,
               first_name AS GivenName, CASE WHEN c_nationkey = 3 THEN 'unknown' ELSE email_address END AS EmailAddr,
               CASE WHEN substr(birth_date, 5, 1) = '-' THEN substr(birth_date, 9, 2) || '/' || substr(birth_date, 6, 2) || '/1980'
                    ELSE birth_date END AS BirthDate, c_nationkey AS CountryOfResidence
        FROM people""",
    "pms_people": """
        SELECT 'G' || lpad(CAST(person_id AS STRING), 8, '0') AS guest_code, last_name, first_name,
               CASE WHEN c_nationkey = 5 THEN '' ELSE email_address END AS email_address, birth_date AS date_of_birth,
               c_nationkey AS nationality_code
        FROM people""",
    "codes_a": "SELECT c_custkey, c_mktsegment AS segment FROM customer",
    "codes_b": """
        SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Building' WHEN 'HOUSEHOLD' THEN ' HOUSEHOLD'
                               WHEN 'MACHINERY' THEN 'MACHINES' ELSE c_mktsegment END AS market_segment
        FROM customer""",
    "snapshot_old": """
        SELECT lower(replace(p_brand, '#', '_')) AS table_name,
               replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING) AS column_name,
               CASE WHEN p_size < 25 THEN 'bigint' ELSE 'string' END AS data_type, p_type AS comment,
               p_brand AS table_comment, p_brand = 'Brand#7' AS dropped
        FROM part WHERE p_brand <> 'Brand#3' AND p_size <> 50""",
    "snapshot_new": """
        SELECT lower(replace(p_brand, '#', '_')) AS table_name,
               CASE WHEN p_size = 12 THEN upper(replace(p_name, ' ', '_')) ELSE replace(p_name, ' ', '_') END
                    || '_' || CAST(p_partkey AS STRING) AS column_name,
               CASE WHEN p_size = 10 THEN 'decimal(10,2)' WHEN p_size < 25 THEN 'bigint' ELSE 'string' END AS data_type,
               CASE WHEN p_size = 11 THEN p_type || ' (new)' ELSE p_type END AS comment,
               CASE WHEN p_brand = 'Brand#9' THEN 'ninth brand' ELSE p_brand END AS table_comment, FALSE AS dropped
        FROM part WHERE p_brand <> 'Brand#5' AND p_size <> 49""",
    "annotations": """
        SELECT 'erp' AS schema_name, lower(replace(p_brand, '#', '_')) AS table_name,
               replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING) AS column_name,
               p_type || ', ' || lower(p_type) || ',' || p_type AS tags,
               CASE WHEN p_size > 40 THEN 'Item' ELSE '' END AS cdm_entity, '' AS cdm_attribute,
               CASE WHEN p_size = 9 THEN ' ' ELSE 'size ' || CAST(p_size AS STRING) END AS notes, p_size AS version
        FROM part""",
}
VIEW_INPUTS = {"people_dup": ["people"], "crm_people": ["people"], "pms_people": ["people"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A planted view over the input tables."""
    for needed in VIEW_INPUTS.get(name, []):
        view(spark, sf_dir, needed).createOrReplaceTempView(needed)
    for t in ("orders", "customer", "nation", "region", "lineitem", "part"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(VIEWS[name])


def with_views(*names: str) -> str:
    """WITH clause that defines planted views for DuckDB."""
    needed = list(dict.fromkeys(n for name in names for n in [*VIEW_INPUTS.get(name, []), name]))
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed) + "\n"


def columns_of(*names: str, kinds: str = "idst") -> list[tuple[str, str, str]]:
    """(table, column, kind) of input tables; kinds: i integer, d double, s text, t timestamp."""
    out = []
    for name in names:
        for part in SCHEMA[name].split():
            column, kind = part.split(":")
            if kind in kinds:
                out.append((name, column, kind))
    return out


def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def long_sql(columns: list[tuple[str, str, str]]) -> str:
    """All values of the columns as (table_name, column_name, value text)."""
    return union_sql([f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {t}"
                      for t, c, _ in columns])


def query(name: str, oracle: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name, with SQL giving the same rows."""

    def register(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return register
