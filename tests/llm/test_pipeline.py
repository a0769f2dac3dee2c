"""The pipeline against brute force, stage by stage, on a small table."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratalens.llm import secrets

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(9), tmp_path_factory.mktemp("sf")
    vocabulary = ["".join(rng.choice("abcdeg") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    text = [" ".join(rng.choices(vocabulary, k=rng.randint(30, 60))) for _ in range(40)]
    item = " ".join(rng.choices(vocabulary, k=20))
    rows = [(i + 1, t) for i, t in enumerate(text)]
    rows += [(100, text[0]), (101, text[0] + " more"), (102, f"{text[1][:40]} {item} {text[2][:60]}"), (103, "my password = hunter2hunter2 " + text[3][::-1]),
             (104, None), (105, ""), (106, "12 34 !?"), (5, text[4]), (None, "some words without an id")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_each_stage(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [sorted(str(r.doc_id) for r in docs.collect())]
    for number, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, folder).write.parquet(str(tmp_path / name))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / name))
        if number < 4:
            assert docs.columns == columns
        kept.append(sorted(str(r.doc_id) for r in docs.collect()))
        if name == "secret_scan":
            masked = docs.filter("doc_id = 103").first()
            assert masked.text.startswith(f"my {secrets.REDACTED} ") and masked.n_chars == len(masked.text)
    gone = [set(a) - set(b) for a, b in zip(kept, kept[1:], strict=False)]
    assert gone == [{"104", "105", "106"}, {"100", "101"}, {"102"}, set(), set()]
    assert kept[2].count("5") == 1 and len(kept[-1]) == 42
    assert all(r.n_tokens == len(r.ids) and r.ids[-1] == 2 for r in docs.collect())


def test_run(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert found.count() == 42 and {"n_tokens", "ids", "ids_sha256", "decoded_sha256"} <= set(found.columns)


def test_empty_tables(spark, folder, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").filter(F.lit(False)).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


#: Names that stages or operators use for columns of their own, and awkward ones.
OWN = ("_key", "_doc", "_bad", "_at", "_blob", "_hits", "found", "_found", "score", "lang_pred", "_nth", "_text", "words", "component_id", "n_shingles", "rank", "_SEEN", "a.b", "a`b")


@pytest.mark.parametrize("number", range(5))
def test_columns_of_any_name_are_left_alone(spark, folder, number):
    """Each stage on rows that carry the names it uses itself: the values of all columns come through."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id IS NOT NULL")
    wide = docs.select("*", *[F.concat_ws("-", F.lit(name), "doc_id").alias(name) for name in OWN])
    found = corpus_pipeline.STAGES[number][1](spark, wide, folder)
    columns = [c for c in wide.columns if c != "text"] if number == 4 else wide.columns
    assert found.columns[:len(columns)] == columns
    plain = sorted(str(r.doc_id) for r in corpus_pipeline.STAGES[number][1](spark, docs, folder).collect())
    rows = found.collect()
    assert sorted(str(r.doc_id) for r in rows) == plain
    assert all(r[columns.index(name)] == f"{name}-{r.doc_id}" for r in rows for name in OWN)
