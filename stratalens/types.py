"""Type families, column metadata and the name conventions every operator shares."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name conventions (case-insensitive regular expressions, valid in Python and Java alike).
KEYISH_NAME = r"(?i)(_?(id|key|code|no|num|nbr|number|cd|ref))$"
DATEISH_NAME = r"(?i)(date|_dt$|^dt_|_dt_|_on$|time|_ts$|^ts_|day|period|month|year)"
GRAIN_NAME = r"(?i)(type|channel|kind|seq|line)"
PII_NAME = (
    r"(?i)(e_?mail|phone|mobile|cell|fax|passport|birth|dob|address|addr_|street|postcode|postal|zip|first_?name"
    r"|last_?name|family_?name|surname|given_?name|full_?name|national_?id|id_?card|ssn|credit_?card|card_?no|iban"
    r"|ip_?addr)"
)

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_MEASURE = (T.FloatType, T.DoubleType, T.DecimalType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def family(dtype: T.DataType) -> str:
    """numeric, temporal, string, bool or other."""
    if isinstance(dtype, _NUMERIC):
        return "numeric"
    if isinstance(dtype, _TEMPORAL):
        return "temporal"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    return "other"


def is_measure_type(data_type: str) -> bool:
    """FLOAT, DOUBLE and DECIMAL columns hold amounts, not keys or codes."""
    return bool(re.match(r"(?i)(float|double|real|decimal|numeric)", data_type or ""))


def is_float_type(data_type: str) -> bool:
    return bool(re.match(r"(?i)(float|double|real)", data_type or ""))


def keyish(name: str) -> bool:
    return bool(re.search(KEYISH_NAME, name))


def dateish(name: str) -> bool:
    return bool(re.search(DATEISH_NAME, name))


class ColumnMeta(NamedTuple):
    col_id: int
    schema_name: str
    table_name: str
    column_name: str
    ordinal: int
    data_type: str
    family: str


COLUMN_META = T.StructType(
    [
        T.StructField("col_id", T.IntegerType(), False),
        T.StructField("schema_name", T.StringType(), False),
        T.StructField("table_name", T.StringType(), False),
        T.StructField("column_name", T.StringType(), False),
        T.StructField("ordinal", T.IntegerType(), False),
        T.StructField("data_type", T.StringType(), False),
        T.StructField("family", T.StringType(), False),
    ]
)


def split_name(name: str) -> tuple[str, str]:
    """'crm.customer' -> ('crm', 'customer'); a bare table name lives in schema 'main'."""
    schema, _, table = name.rpartition(".")
    return schema or "main", table


def column_list(tables: dict[str, DataFrame]) -> list[ColumnMeta]:
    """One entry per column of every table; col_id numbers them across all tables."""
    out: list[ColumnMeta] = []
    for name, df in tables.items():
        schema, table = split_name(name)
        for ordinal, field in enumerate(df.schema.fields, start=1):
            out.append(
                ColumnMeta(len(out), schema, table, field.name, ordinal, field.dataType.simpleString(),
                           family(field.dataType))
            )
    return out


def column_frame(spark: SparkSession, columns: list[ColumnMeta]) -> DataFrame:
    return spark.createDataFrame(columns, COLUMN_META)


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, rounded; 0 where the whole is empty."""
    ratio = F.lit(100.0) * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return F.coalesce(F.round(ratio, digits), F.lit(0.0))
