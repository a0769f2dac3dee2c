"""A training corpus from `documents`: each stage applies one operator of stratalens.llm, is written as Parquet and read again.

Every stage takes all that its predecessor kept, and all but the last return its columns. Null, empty, repeated and very long texts pass
through the operators as their docstrings say; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalens.llm import decontaminate, langid, ngram_join, pieces, secrets
from stratalens.llm.common import bucket, fitting, own, unused
from stratalens.llm.queries import public_model
from stratalens.staging import shared_folder, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Rows that go to a Python worker at once: whole texts, of which Spark's default of 10,000 would take much memory on both sides.
ROWS_AT_ONCE = 2_000


def whole_texts(spark: SparkSession) -> None:
    """Lets the session send no more than ROWS_AT_ONCE rows to a Python worker at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_AT_ONCE:
        spark.conf.set(key, str(ROWS_AT_ONCE))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; those without a letter or a text go."""
    whole_texts(spark)
    return langid.in_known_language(docs, bucket("doc_id", 3) != 1)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar texts, directly or through others, the one with the smallest id stays, once."""
    whole_texts(spark)
    found = stage(ngram_join.classes(docs.select("doc_id", "text")), "classes")
    dropped = fitting(stage(found.filter("doc_id <> component_id").select("doc_id").distinct(), "dropped"))
    # ids that stand on several rows are rare; only these are ranked
    repeated = fitting(stage(found.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated"))
    kept = docs.join(dropped, "doc_id", "left_anti")
    nth = unused(docs, "_nth")
    again = kept.join(repeated, "doc_id", "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")))
    return kept.join(repeated, "doc_id", "left_anti").unionByName(again.filter(F.col(nth) == 1).drop(nth)).select(own(docs))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in the text and n_chars counted again where that changed it."""
    return secrets.redact(docs, secrets.new_ledger(spark), size="n_chars" if "n_chars" in docs.columns else None)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document in place of its text, with digests of the ids and of what they decode to."""
    whole_texts(spark)
    return pieces.tokenize(docs, pieces.model_bytes(public_model()), with_ids=True)


STAGES: list[tuple[str, Stage]] = [("language_id", known_language), ("ngram_join", one_of_each), ("decontamination", without_benchmarks),
                                   ("secret_scan", without_secrets), ("sentencepiece", tokens)]

#: SQL has no form of the learned and iterated stages; the tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, step) in enumerate(STAGES):
        step(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
