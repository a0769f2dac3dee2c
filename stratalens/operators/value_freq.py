"""Every distinct value of every column with its number of rows: the table most analyses are computed from.

Counted with map-side combine: a value held by a third of all rows leaves each map task as one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.functions import values as V
from stratalens.types import ColumnMeta, column_list, family, split_name

Tables = dict[str, DataFrame]


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name, pairwise: the plan stays flat and quick to analyse for many frames."""
    while len(frames) > 1:
        pairs = [frames[i:i + 2] for i in range(0, len(frames), 2)]
        frames = [a.unionByName(*b) if b else a for a, *b in pairs]
    return frames[0]


def meta_of(tables: Tables, columns: dict[str, list[str]] | None = None) -> list[ColumnMeta]:
    """Metadata of all columns, or of the named ones per table."""
    metas = column_list(tables)
    if columns is None:
        return metas
    wanted = {(*split_name(t), c.lower()) for t, names in columns.items() for c in names}
    return [m for m in metas if (m.schema_name, m.table_name, m.column_name.lower()) in wanted]


def value_freq(tables: Tables, metas: list[ColumnMeta] | None = None, by_text: bool = False) -> DataFrame:
    """One row per distinct value of every column, nulls included:

    col_id, family, value (text form), num (numbers as double), whole (integers, or microseconds of dates and times),
    text_len, is_email, is_phone, trimmed (of texts), n.

    by_text: numbers that are equal but have another text, which is 0.0 and -0.0, are counted apart.

    Columns of one type are counted together in their own type, each group of columns reading only its own part of the
    table; values become text once they are distinct. Written as one SQL query: that is analysed once, however many
    tables it covers."""
    metas = column_list(tables) if metas is None else metas
    views, parts = {}, []
    for i, (name, df) in enumerate(tables.items()):
        views[f"t{i}"] = df
        types = {f.name: f.dataType for f in df.schema.fields}
        kinds: dict[str, list[ColumnMeta]] = {}
        for m in metas:
            if (m.schema_name, m.table_name) == split_name(name):
                kinds.setdefault(_counted_as(types[m.column_name]), []).append(m)
        parts += [_counts_of_type(f"t{i}", kind, same, types, by_text) for kind, same in kinds.items()]
    families = ", ".join(f"'{m.family}'" for m in column_list(tables))
    told = {name: sql.replace("{", "{{").replace("}", "}}") for name, sql in V.counted_text("key").items()}
    value = told.pop("value")
    texts = ", ".join(f"if(is_text, {sql}, NULL) AS {name}" for name, sql in told.items())
    used = {v: df for v, df in views.items() if any(f"{{{v}}}" in p for p in parts)}
    return next(iter(tables.values())).sparkSession.sql(
        f"""SELECT col_id, element_at(array({families}), col_id + 1) AS family, if(is_text, {value}, key) AS value, num, whole,
                   {texts}, n FROM ({" UNION ALL ".join(parts)})""", **used)


def _counted_as(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return "bigint"
    return dtype.simpleString() if family(dtype) in ("numeric", "temporal", "bool") else "text"


def _counts_of_type(view: str, kind: str, metas: list[ColumnMeta], types: dict[str, T.DataType], by_text: bool) -> str:
    """SQL for (col_id, key, num, whole, is_text, n) of columns that are counted in the same type."""

    def form(m: ColumnMeta) -> str:
        if kind == "text":
            text = V.text_of(m.column_name, types[m.column_name])
            return V.count_key(text).replace("{", "{{").replace("}", "}}")
        return f"CAST({V.quoted(m.column_name)} AS bigint)" if kind == "bigint" else V.quoted(m.column_name)

    columns = ", ".join(f"{form(m)} AS `{m.col_id}`" for m in metas)
    ids = ", ".join(f"`{m.col_id}`" for m in metas)
    fam = metas[0].family
    number = "CAST(v AS double)" if fam == "numeric" else "CAST(NULL AS double)"
    whole = "v" if kind == "bigint" else "unix_micros(CAST(v AS timestamp))" if fam == "temporal" else "CAST(NULL AS bigint)"
    # grouping takes both zeros for one
    apart = by_text and kind in ("float", "double")
    sign, key = (", v = 0 AND CAST(v AS string) = '-0.0' AS minus", "if(minus, '-0.0', CAST(v AS string))") if apart else ("", "CAST(v AS string)")
    return f"""
        SELECT CAST(col_id AS int) AS col_id, {key} AS key, {number} AS num, {whole} AS whole,
               {str(kind == "text").lower()} AS is_text, n
        FROM (SELECT col_id, v{", minus" if apart else ""}, count(*) AS n FROM (SELECT col_id, v{sign} FROM (SELECT {columns} FROM {{{view}}})
              UNPIVOT INCLUDE NULLS (v FOR col_id IN ({ids}))) GROUP BY col_id, v{", minus" if apart else ""})"""


def top_per_group(df: DataFrame, group: list[str], order: list, keep: int, rank: str = "rank") -> DataFrame:
    """The first `keep` rows of each group. Spark cuts each task's rows to `keep` per group before the shuffle
    (WindowGroupLimit), so a group never arrives whole in one task."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(rank, place).where(F.col(rank) <= keep)
