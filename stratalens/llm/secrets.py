"""Secret scans over an incremental ledger of blobs, in built-in functions only.

Every version of a text is addressed by the SHA-256 of its content. The ledger has a row for each blob and run: which rules, in which
versions, were run over it, and the lengths of matches and of what lies between them. A scan looks only at pairs of a blob and a rule
version that no earlier run has seen, so copies, unchanged files and renamed paths cost a hash. A run's rows are written in one commit; a
run that fails leaves nothing, and its pairs are scanned by the next. Findings are joined back to every path that has the blob.

Defined results: a null text is the empty text, which has no findings. Repeated rows each give a row. Other columns are left alone, whatever
their names: columns made beside them take names that are free. A blob's matches meet in one window, no other group is held together.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalens.llm.common import fitting, own, unused
from stratalens.staging import shared_folder


@dataclass(frozen=True)
class Rule:
    """kind: its name, without colons and commas. A match counts if `group` of it has at least `least` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base rules. A run of hex digits or of an access key's characters is matched as a whole or not at all, so its least length can
#: stand in the pattern; an assignment that is too short still uses up its characters, so its length is tested afterwards.
BASE = (Rule("assign", 1, """(?i)(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        Rule("access", 1, "AKIA[A-Z0-9]{16,}"), Rule("hex", 1, "[0-9a-f]{24,}"))
#: What may stand between the lines of a key: white space, also as escapes, and marks of quoting; headers before its base64 lines.
_GAP = r"""(?:\\[rnt]|\s|-(?!----)|["'>#*|,;.])*+"""
_HEADERS = rf"(?:{_GAP}[A-Za-z][A-Za-z0-9-]{{0,40}}:[^\r\n\\]*+)*+"
#: A private key up to its END line. Without one: up to the end of its base64 lines, the last of which may be short, or of a line that the
#: text breaks off. Groups are repeated possessively, which takes no stack; no part goes beyond the next five dashes, so time is linear.
_KEY = (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-{5,6}END [A-Z ]{0,40}PRIVATE KEY-----"
        rf"|{_HEADERS}(?:{_GAP}[A-Za-z0-9+/=]{{16,}}+)++(?:{_GAP}[A-Za-z0-9+/=]++)?|{_GAP}[A-Za-z0-9+/=]++\s*+\z)?")
MORE = (Rule("pem", 2, _KEY), Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
        Rule("forge", 1, "gh[pousr]_[A-Za-z0-9]{36,}"))
RULES = BASE + MORE

LEDGER = "_blob string, pairs array<string>, hits array<struct<rule: string, gaps: array<int>, sizes: array<int>, tested: array<int>>>"
#: What stands in a text for a secret.
REDACTED = "[SECRET]"


def blob(text: str = "text") -> Column:
    """The address of a text's content."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def lengths(parts: Column) -> Column:
    return F.transform(parts, F.length)


def hit(text: Column, rule: Rule) -> Column:
    """Lengths of a rule's matches and of the texts before them; null without a match."""
    found = F.struct(F.lit(rule.key).alias("rule"), lengths(F.split(text, rule.pattern, -1)).alias("gaps"),
                     lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))).alias("sizes"),
                     lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))).alias("tested"))
    return F.when(text.rlike(rule.pattern), found)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All runs of a ledger; an absent one is empty."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{ledger}/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger hasn't seen of versions (text, and other columns), adds it to the ledger, and returns the ledger."""
    spark = versions.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).alias("_text")
    unique = versions.select(blob().alias("_blob"), text).groupBy("_blob").agg(F.first("_text").alias("_text"))
    seen = read_ledger(spark, ledger).groupBy("_blob").agg(F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("_seen"))
    every = F.array(*[F.lit(r.key) for r in rules])
    fresh = (unique.join(seen, "_blob", "left").withColumn("pairs", F.array_except(every, F.coalesce("_seen", F.array().cast("array<string>"))))
             .filter(F.size("pairs") > 0))
    hits = F.array_compact(F.array(*[F.when(F.array_contains("pairs", r.key), hit(F.col("_text"), r)) for r in rules]))
    fresh.select("_blob", "pairs", hits.alias("hits")).write.parquet(f"{ledger}/{uuid.uuid4().hex}")
    return read_ledger(spark, ledger)


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """_blob, kind, place (of the kind among the rules), start and end of each match that counts, in code points."""
    least = F.create_map(*[x for r in rules for x in (F.lit(r.key), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least"),
                                                                            F.lit(rules.index(r)).alias("place")))])
    hits = ledger.filter(F.size("hits") > 0).select("_blob", F.explode("hits").alias("hit")).select("_blob", "hit.*")
    # a run that was repeated can have written a pair twice
    hits = hits.filter(F.col("rule").isin([r.key for r in rules])).dropDuplicates(["_blob", "rule"])
    each = F.arrays_zip(F.slice("gaps", F.lit(1), F.size("sizes")).alias("gap"), F.col("sizes").alias("size"), F.col("tested").alias("test"))
    rows = hits.select("_blob", "rule", F.posexplode(each).alias("at", "m")).select("_blob", "rule", "at", "m.gap", "m.size", "m.test")
    before = Window.partitionBy("_blob", "rule").orderBy("at")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before)).withColumn("_rule", least[F.col("rule")])
    return rows.filter(F.col("test") >= F.col("_rule.least")).select(
        "_blob", F.col("_rule.kind").alias("kind"), F.col("_rule.place").alias("place"), (F.col("end") - F.col("size")).alias("start"), "end")


def by_blob(found: DataFrame) -> DataFrame:
    """All findings of a blob as one array, by start and place of the kind."""
    return found.groupBy("_blob").agg(F.sort_array(F.collect_list(F.struct("start", "place", "kind", "end"))).alias("found"))


def joined(found: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def new_ledger(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"


def digests(docs: DataFrame, ledger: str) -> DataFrame:
    """A row for each document: counts of the base kinds, a digest of their spans, and all spans."""
    none = F.array().cast("array<struct<start: bigint, place: int, kind: string, end: bigint>>")
    found = by_blob(findings(scan(docs, ledger)))
    paths = docs.select("doc_id", blob().alias("_blob")).join(found, "_blob", "left").withColumn("found", F.coalesce("found", none))

    def count(place: int) -> Column:
        return F.size(F.filter("found", lambda x: x["place"] == place)).cast("long")

    counts = [count(place).alias(f"n_{r.kind}") for place, r in enumerate(BASE)]
    base = F.filter("found", lambda x: x["place"] < len(BASE))
    return paths.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, ledger: str, size: str | None = None) -> DataFrame:
    """docs with every finding in text replaced and, if named, the column size set to the new length; other rows stay as they are."""
    address, hits = unused(docs, "_blob"), unused(docs, "_hits")
    found = findings(scan(docs, ledger)).withColumnRenamed("_blob", address)
    with_blob = docs.withColumn(address, blob())
    affected = fitting(found.select(address).distinct())
    state = "struct<at: bigint, out: string>"

    def step(acc: Column, x: Column) -> Column:
        skip = F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))
        kept = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        return F.when(x["start"] < acc["at"], skip).otherwise(F.struct(x["end"].alias("at"), F.concat(acc["out"], kept, F.lit(REDACTED)).alias("out")))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")).cast(state)
    masked = F.aggregate(hits, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    every = by_blob(found.withColumnRenamed(address, "_blob")).withColumnsRenamed({"_blob": address, "found": hits})
    secret = with_blob.join(affected, address, "left_semi").join(every, address).withColumn("text", masked)
    if size:
        secret = secret.withColumn(size, F.length("text").cast(docs.schema[size].dataType))
    return with_blob.join(affected, address, "left_anti").select(own(docs)).unionByName(secret.select(own(docs)))
