"""The pipeline's stages, one after the other, and the queries' names."""

import glob
import os

import __spark_entry__
import corpus_pipeline
import pytest
from ledgerloom.llm import line_dedup, simhash


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if k < 3:
            assert 0 < docs.count() <= before
            before = docs.count()
    assert docs.where("n_tokens <> size(ids)").count() == 0
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == sorted(r.doc_id for r in docs.collect())


def test_stages_on_odd_tables(spark, docs, empty, doubled, rows):
    kept = line_dedup.without_repeated_lines(docs)
    want = {i: c for i, _, _, c in line_dedup.brute(rows)}
    import hashlib

    assert {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in kept.collect()} == want
    assert kept.columns == docs.columns and kept.schema["text"].dataType == docs.schema["text"].dataType
    one = simhash.one_of_each(doubled).where("doc_id IS NOT NULL")
    assert one.count() == one.select("doc_id").distinct().count()
    assert line_dedup.without_repeated_lines(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


@pytest.mark.parametrize("table", ["docs", "doubled", "empty"])
def test_run_on_odd_tables(spark, request, tmp_path, sf, table):
    """Nulls in any column, empty and long texts, rows that repeat, no rows, and columns with names that stages use inside."""
    docs = request.getfixturevalue(table)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(got) == (table != "empty") and all(r.n_tokens == len(r.ids) for r in got)
    kept = {r.doc_id for r in got}
    assert kept <= {r.doc_id for r in docs.select("doc_id").collect()}
    if table == "docs":  # of exact and near copies one at most stays, and documents without any stay or go by the mix alone
        assert len(kept & {0, 1, 2}) <= 1 and len(kept & {80, 81, 82, 83}) <= 1 and len(kept & set(range(7, 60))) > 20
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    assert all(len(os.listdir(p)) == 1 for p in glob.glob(f"{folder}/pipeline-*"))  # the last stage's input alone


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert {f"op{n}_" for n in range(1, 11)} == {q.split("_")[0] + "_" for q in names if q.startswith("op")}
