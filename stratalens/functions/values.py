"""Column expressions over single values: text form, shape, placeholders, dates in text, comparable forms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.types import col, family, keyish

# Texts that stand for "no value" (compared upper-cased and trimmed).
PLACEHOLDERS = [
    "N/A", "N.A.", "#N/A", "NULL", "(NULL)", "NONE", "NIL", "-", "--", "---", "?", ".", "UNKNOWN", "UNK", "TBD", "TBA",
    "NOT APPLICABLE", "NOT AVAILABLE", "MISSING", "(BLANK)", "0000-00-00", "1900-01-01", "01/01/1900", "9999-12-31",
    "31/12/9999",
]
# In key-like columns these mean "no value" as well.
KEY_PLACEHOLDERS = ["0", "-1"]
# Words of yes/no columns.
BOOL_WORDS = ["Y", "N", "YES", "NO", "TRUE", "FALSE", "T", "F"]
# Date formats in the order they are tried (strftime name, required shape, Java pattern).
DATE_FORMATS = [
    ("%Y-%m-%d", r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    ("%d/%m/%Y", r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    ("%m/%d/%Y", r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    ("%d.%m.%Y", r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    ("%Y/%m/%d", r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    ("%d-%b-%Y", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    ("%d %b %Y", r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    ("%d-%m-%Y", r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
]
COMPACT_DATE = ("%Y%m%d", r"^\d{8}$", "yyyyMMdd")
EMAIL_VALUE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE_VALUE = r"^\+?\(?[0-9][0-9 ()\-.]{6,}$"
# Accented Latin letters and the plain letters they fold to (same position).
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"

SHOWN_CHARS = 200     # longer texts are shown cut
SHAPE_CHARS = 40      # of a value's shape
LONG_TEXT = 256       # longer texts are counted by a key of bounded size


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_of(name: str, dtype: T.DataType) -> str:
    """SQL for the text form of a column."""
    if isinstance(dtype, T.BinaryType):
        return f"hex({quoted(name)})"
    if isinstance(dtype, (T.MapType, T.StructType, T.VariantType)):
        return f"to_json({quoted(name)})"
    return f"CAST({quoted(name)} AS STRING)"


# A long text is counted by a key of fixed-width fields: digest of the whole text, marks (the whole text looks like an
# e-mail, like a phone, is short without the spaces around it), its length, its first characters, and that short form.
# First positions, counted from 1:
_DIGEST, _LENGTH = 64, 12
_MARKS, _SIZE, _START = _DIGEST + 1, _DIGEST + 4, _DIGEST + 4 + _LENGTH


def count_key(text: str) -> str:
    """SQL for what equal texts are grouped by: the text, or a bounded key for a long one."""
    short = f"length(trim({text})) <= {LONG_TEXT}"
    mark = lambda test: f"if({test}, '1', '0')"
    return (
        f"CASE WHEN length({text}) > {LONG_TEXT} THEN concat(sha2({text}, 256), {mark(f"{text} RLIKE r'{EMAIL_VALUE}'")}, "
        f"{mark(f"{text} RLIKE r'{PHONE_VALUE}'")}, {mark(short)}, lpad(CAST(length({text}) AS STRING), {_LENGTH}, '0'), "
        f"left({text}, {SHOWN_CHARS}), if({short}, trim({text}), '')) ELSE {text} END")


def counted_text(key: str) -> dict[str, str]:
    """SQL of what a count key tells: value (unique per text), its length, e-mail and phone tests, its trimmed form."""
    long = f"length({key}) > {LONG_TEXT}"
    value = f"concat(substring({key}, {_START}, {SHOWN_CHARS}), '…', left({key}, {_DIGEST}))"
    marked = lambda i: f"substring({key}, {_MARKS + i}, 1) = '1'"
    rest = f"substring({key}, {_START + SHOWN_CHARS}, {LONG_TEXT})"
    return {
        "value": f"if({long}, {value}, {key})",
        "text_len": f"if({long}, CAST(substring({key}, {_SIZE}, {_LENGTH}) AS INT), length({key}))",
        "is_email": f"if({long}, {marked(0)}, {key} RLIKE r'{EMAIL_VALUE}')",
        "is_phone": f"if({long}, {marked(1)}, {key} RLIKE r'{PHONE_VALUE}')",
        "trimmed": f"if({long}, if({marked(2)}, {rest}, {value}), trim({key}))",
    }


def shown(value: Column) -> Column:
    cut = F.concat(F.left(value, F.lit(SHOWN_CHARS)), F.lit("…"))
    return F.when(F.length(value) > SHOWN_CHARS, cut).otherwise(value)


def shape(value: Column) -> Column:
    """The shape of a value is that of its start: A for upper, a for lower, 9 for digits. By definition it has this many characters."""
    out = F.left(value, F.lit(SHAPE_CHARS))
    for letters, mark in (("[A-Z]", "A"), ("[a-z]", "a"), ("[0-9]", "9")):
        out = F.regexp_replace(out, letters, mark)
    return out


def squeezed_shape(shape_col: Column) -> Column:
    """The shape with runs shortened to one mark."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(shape_col, "A+", "A"), "a+", "a"), "9+", "9")


def is_placeholder(value: Column, is_key: Column | bool) -> Column:
    """A text that means "no value"; key_like columns also count 0 and -1."""
    key_like = F.lit(is_key) if isinstance(is_key, bool) else is_key
    text = F.upper(F.trim(value))
    return text.isin(PLACEHOLDERS) | (key_like & text.isin(KEY_PLACEHOLDERS))


def is_sentinel_year(moment: Column) -> Column:
    return (F.year(moment) <= 1900) | (F.year(moment) >= 9999)


def filled(name: str, dtype: T.DataType) -> Column:
    """True where the column has a real value: not null, blank, placeholder or sentinel date."""
    return is_real(col(name), dtype, keyish(name))


def is_real(c: Column, dtype: T.DataType, key_like: bool) -> Column:
    fam = family(dtype)
    if fam == "string":
        real = (F.trim(c) != "") & ~is_placeholder(c, key_like)
    elif fam == "temporal":
        real = ~is_sentinel_year(c)
    elif fam == "numeric" and key_like:
        real = ~c.cast("double").isin(0.0, -1.0)
    else:
        real = F.lit(True)
    return c.isNotNull() & real


def parse_date(text: str, fmt: tuple[str, str, str]) -> str:
    """SQL for a timestamp where the trimmed text has exactly this format, else null."""
    _, required, java = fmt
    return f"CASE WHEN {text} RLIKE r'{required}' THEN try_to_timestamp({text}, '{java}') END"


def parse_iso_timestamp(text: str) -> str:
    return rf"CASE WHEN {text} RLIKE r'^\d{{4}}-\d{{2}}-\d{{2}}' THEN try_cast({text} AS timestamp) END"


def formats_named(names: list[str]) -> list[tuple[str, str, str]]:
    known = {f[0]: f for f in [*DATE_FORMATS, COMPACT_DATE]}
    return [known[n] for n in names if n in known]


def parse_any_date(text: str, formats: list[tuple[str, str, str]] | None = None) -> str:
    """SQL for the date in a trimmed text: the first format that parses wins; ISO timestamps last."""
    tries = [parse_date(text, f) for f in (DATE_FORMATS if formats is None else formats)]
    return f"coalesce({', '.join([*tries, parse_iso_timestamp(text)])})"


def value_kind(text: str, date_like: Column | bool) -> Column:
    """int, decimal, bool, date:<format>, timestamp or text: what a trimmed text would parse as."""
    date_like = F.lit(date_like) if isinstance(date_like, bool) else date_like
    words = ", ".join(f"'{w}'" for w in BOOL_WORDS)
    dates = " ".join(f"WHEN {parse_date(text, f)} IS NOT NULL THEN 'date:{f[0]}'" for f in DATE_FORMATS)
    rest = F.expr(f"""
        CASE WHEN {text} RLIKE '^[+-]?[0-9]+$' THEN 'int'
             WHEN {text} RLIKE '^[+-]?([0-9]+[.][0-9]*|[.][0-9]+)$' THEN 'decimal'
             WHEN upper({text}) IN ({words}) THEN 'bool' {dates}
             WHEN {parse_iso_timestamp(text)} IS NOT NULL THEN 'timestamp' ELSE 'text' END""")
    compact = F.expr(f"{parse_date(text, COMPACT_DATE)} IS NOT NULL")
    return F.when(date_like & compact, F.lit("date:" + COMPACT_DATE[0])).otherwise(rest)


def fold_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED + ACCENTED.upper(), PLAIN + PLAIN.upper())


def comparable(value: str, dtype: T.DataType, as_date: bool) -> Column:
    """Form in which two systems' values (SQL) are compared; blanks and placeholders become null."""
    v = f"trim(CAST({value} AS STRING))"
    if as_date:
        form = f"CAST(to_date({parse_any_date(v)}) AS STRING)"
    elif family(dtype) == "numeric":
        form = f"CAST(try_cast({v} AS double) AS STRING)"
    else:
        form = rf"lower(regexp_replace({v}, r'\s+', ' '))"
    return F.expr(f"CASE WHEN {v} <> '' AND NOT {placeholder_test(v)} THEN {form} END")


def placeholder_test(text: str, key_like: bool = False) -> str:
    words = ", ".join(f"'{w}'" for w in PLACEHOLDERS + (KEY_PLACEHOLDERS if key_like else []))
    return f"upper({text}) IN ({words})"


def spark_date_format(strftime: str) -> str:
    """strftime format -> Java pattern."""
    # Directive by directive.
    for directive, pattern in [("%Y", "yyyy"), ("%m", "MM"), ("%d", "dd"), ("%b", "MMM"), ("%H", "HH"), ("%M", "mm"),
                               ("%S", "ss")]:
        strftime = strftime.replace(directive, pattern)
    return strftime


def spark_date_format_col(strftime: Column) -> Column:
    """spark_date_format over a column of formats."""
    out = strftime
    for directive in ("%Y", "%m", "%d", "%b", "%H", "%M", "%S"):
        out = F.replace(out, F.lit(directive), F.lit(spark_date_format(directive)))
    return out


def pattern_regex(shape_col: Column) -> Column:
    """Value shape -> anchored regular expression ('AA99' -> ^[A-Z]{2}[0-9]{2}$)."""
    runs = F.regexp_extract_all(shape_col, F.lit(r"(A+|a+|9+|[^Aa9])"), F.lit(1))

    def one_run(run: Column) -> Column:
        times = F.when(F.length(run) > 1, F.concat(F.lit("{"), F.length(run).cast("string"), F.lit("}"))).otherwise("")
        mark = F.left(run, F.lit(1))
        return (
            F.when(mark == "A", F.concat(F.lit("[A-Z]"), times))
            .when(mark == "a", F.concat(F.lit("[a-z]"), times))
            .when(mark == "9", F.concat(F.lit("[0-9]"), times))
            .otherwise(F.regexp_replace(run, r"([()\[\]{}?*+\-|^$\\.&~#\s])", r"\\$1"))
        )

    return F.concat(F.lit("^"), F.array_join(F.transform(runs, one_run), ""), F.lit("$"))


def words_of(name: str) -> list[str]:
    """'CustomerId' or 'customer_id' -> ['customer', 'id']."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower().split("_")
