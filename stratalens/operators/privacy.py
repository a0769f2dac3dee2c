"""Personal data: which columns hold it, and masking that keeps values comparable."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.operators.profile import Counted, count_values
from stratalens.operators.value_freq import Tables
from stratalens.types import col

# Mark and length of a masked value.
PREFIX, TOKEN = "pii_", 16
# Names of columns that hold a personal value.
PERSONAL = (
    r"(?i)(e_?mail|phone|mobile|cell_?(no|num|phone)|fax|passport|national_?id|id_?card|\bssn\b|social_?sec|"
    r"credit_?card|card_?holder|birth|\bdob\b|first_?name|last_?name|middle_?name|given_?name|family_?name|sur_?name|"
    r"full_?name|maiden|guest_?name|street|address|addr_?\d|ip_?addr)")
# Identity numbers, personal although their names end like keys.
IDENTITY = (
    r"(?i)(passport_?(no|num|number)?$|tax_?(id|identifier|no|number)|national_?id|id_?card|migration_?card|"
    r"card_?(no|num|number)$)")
# Endings that say the column is about structure (a key, type, flag, setting, date of the row).
STRUCTURAL = (
    r"(?i)(id|key|type|typ|status|flag|ind|indicator|seq|sequence|count|cnt|code|cd|version|pref|preference|optin|"
    r"consent|verified|valid|primary|format|usage|category|class|source|method|level|order|rank|check|checked|required|"
    r"yn|extension|ext|body|subject|template|message|folio|policy|insert(ed)?(date|dt|ts|time)?|"
    r"update(d)?(date|dt|ts|time)?|create(d)?(date|dt|ts|time)?|modif\w*)$")
# Columns and tables about businesses, not people.
BUSINESS_COLUMN = r"(?i)(web_?site|url|\bhq|_hq|hq_|bank|merchant|dsn|dns|access_?number|mask|optin|opt_in)"
BUSINESS_TABLE = (
    r"(?i)^([a-z]\d_?|dim_?|ref_?)?(propert(y|ies)|organi[sz]ation|org|travel_?agency|agency|company|companies|vendor|"
    r"supplier|merchant|bank|hotel|room|roomtype|transaction_?code|rate_?plan|promotion|outlet)s?$")


def pii_reason(column: Column, fam: Column, flags: Column, tags: Column, table: Column) -> Column:
    """Why a column is masked, null if it is not. Tags win, then business tables and columns are left alone, then the
    content and the name decide."""
    base = F.regexp_replace(F.regexp_replace(F.lower(column), "[^a-z0-9_]", ""), r"\d+$", "")
    flat = F.replace(base, F.lit("_"), F.lit(""))
    tags = F.coalesce(tags, F.lit(""))
    kept = F.lit(None).cast("string")
    personal = base.rlike(PERSONAL) & ~flat.rlike(STRUCTURAL)
    return (
        F.when(tags.rlike(r"(?i)\bno[-_ ]?pii\b"), kept)
        .when(tags.rlike(r"(?i)\bpii\b"), "tagged PII")
        .when(table.rlike(BUSINESS_TABLE) | column.rlike(BUSINESS_COLUMN), kept)
        .when(F.array_contains(flags, "pii_email"), "values look like e-mail addresses")
        .when(F.array_contains(flags, "pii_phone"), "values look like phone numbers")
        .when(base.rlike(IDENTITY) & (fam == "string"), "an identity / tax / card number")
        .when(personal & (fam == "string"), "name looks like personal data")
        .when(personal & fam.isin("temporal", "numeric") & base.rlike(r"birth|\bdob\b"), "birth date (or part of it)"))


def pii_columns(catalog: DataFrame) -> DataFrame:
    """(schema_name, table_name, column_name, kind, reason) of the columns to mask.

    catalog: one row per column with family, flags and tags."""
    email = F.array_contains("flags", "pii_email") | F.col("column_name").rlike(r"(?i)e_?mail")
    reason = pii_reason(F.col("column_name"), F.col("family"), F.coalesce("flags", F.array().cast("array<string>")),
                        F.col("tags"), F.col("table_name"))
    return catalog.withColumn("reason", reason).where("reason IS NOT NULL").select(
        "schema_name", "table_name", "column_name", F.when(F.coalesce(email, F.lit(False)), "email").otherwise("other").alias("kind"),
        "reason")


def mask_value(value: Column, salt: str, email: bool | Column = False) -> Column:
    """pii_ and a token of the salted digest; the domain of an e-mail stays readable; masking again changes nothing."""
    text = value.cast("string")
    token = F.concat(F.lit(PREFIX), F.left(F.sha2(F.concat(F.lit(salt), text), 256), F.lit(TOKEN)))
    is_email = F.lit(email) if isinstance(email, bool) else email
    domain = F.when(is_email & text.contains("@"), F.concat(F.lit("@"), F.element_at(F.split(text, "@"), -1))).otherwise("")
    return F.when(text.startswith(PREFIX), text).otherwise(F.concat(token, domain))


def mask_text(value: str, salt: str, email: bool = False) -> str:
    """mask_value for a value typed by a user."""
    if value.startswith(PREFIX):
        return value
    token = PREFIX + hashlib.sha256((salt + value).encode()).hexdigest()[:TOKEN]
    return token + "@" + value.rsplit("@", 1)[1] if email and "@" in value else token


def mask_pii(df: DataFrame, kinds: dict[str, str], salt: str) -> DataFrame:
    """The table with its personal columns masked; kinds: column -> 'email' or 'other'."""
    return df.withColumns({c: mask_value(col(c), salt, kind == "email") for c, kind in kinds.items()})


def masked_counts(tables: Tables, kinds: dict[str, dict[str, str]], salt: str) -> Counted:
    """Value counts with personal columns masked; kinds: column -> kind, per table.

    Values are masked before they are counted. Whatever a count or a profile made of it says of a value (its text, trimmed form, number,
    length, extremes, frequent values, placeholders) is then said of the token, and the token of a long text is that of the whole text, as
    in mask_pii, so counts and tables still join."""
    return count_values({name: mask_pii(df, kinds.get(name, {}), salt) for name, df in tables.items()})


def mask_display(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table for showing around: personal values as bullets, empty ones stay empty."""
    return df.withColumns({c: F.when(col(c).isNotNull(), F.lit("••••••")) for c in columns})
