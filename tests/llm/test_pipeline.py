"""Rows of the corpus pipeline that have no id or share one."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from feedloom.llm import components
from feedloom.llm.decontaminate import benchmark_matches

LEAK = "the quick brown fox jumps over the lazy dog near the old mill"
SCHEMA = "doc_id long, text string, lang string"


def plain(word, n=200):
    return " ".join(f"{word}{i}" for i in range(n))


@pytest.fixture
def sf_dir(spark, tmp_path):
    items = [(i, f"{plain('item')} {i}") for i in range(9)] + [(9, LEAK)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_benchmark_passages_go_from_rows_without_id(spark, sf_dir):
    rows = [(None, f"so {LEAK} ends", "en"), (None, "clean", "en"), (None, None, "en"), (1, LEAK, "en"), (2, "clean too", None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("x")).withColumn("matches", F.lit(7))
    left = corpus_pipeline.without_benchmarks(spark, docs, sf_dir)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([(None, "clean"), (None, None), (2, "clean too")], key=repr)
    found = benchmark_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), block_bytes=300, with_row=True)
    assert {(r["row"]["doc_id"], r["row"]["text"]) for r in found.filter("size(matches) > 0").collect()} == {(None, rows[0][1]), (1, LEAK)}


def test_rows_that_share_an_id_are_judged_one_by_one(spark, sf_dir):
    a, b, c = plain("a"), plain("b"), plain("c")
    rows = [(1, a), (2, b), (2, a), (1, a), (None, a), (None, a), (3, c), (3, c), (4, b), (5, a + " more"), (7, plain("d")), (7, plain("e"))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], SCHEMA).withColumn("number", F.lit(1)).withColumn("place", F.lit(2)).repartition(3)
    left = corpus_pipeline.one_of_each(spark, docs, sf_dir)
    assert left.columns == docs.columns
    want = [(None, a), (None, a), (1, a), (2, b), (3, c), (7, plain("d")), (7, plain("e"))]
    assert sorted(((r["doc_id"], r["text"]) for r in left.filter("doc_id <> 5 or doc_id is null").collect()), key=repr) == sorted(want, key=repr)
    mixed = spark.createDataFrame([(5, LEAK, "en"), (5, "clean", "en"), (6, "clean", "en")], SCHEMA)
    kept = corpus_pipeline.without_benchmarks(spark, mixed, sf_dir)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(5, "clean"), (6, "clean")]


def test_near_duplicates_leave_no_copy_of_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(components, "checkpoint_root", lambda _: str(tmp_path))
    docs = spark.createDataFrame([(i, f"{plain('a')} {i % 7}", "en") for i in range(20)] + [(50, plain("b"), "en")] * 2, SCHEMA)
    left = corpus_pipeline.one_of_each(spark, docs, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in left) == [0, 50]
    assert {p.name for p in tmp_path.glob("llm/*/*")} <= {"fingerprints", "distinct", "edges", "links"}


def test_without_labels_or_rows_nothing_is_rejected(spark, sf_dir):
    rows = [(1, "some text", None), (2, None, "en"), (None, "", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, corpus_pipeline.known_language(spark, docs, sf_dir).collect()), key=repr) == sorted(rows, key=repr)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).collect() == []
