"""The pipeline on the smallest table, stage by stage against what each must do."""

import pytest

from quakeframe.llm import decontaminate

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        assert out.columns[: len(columns)] == columns
        ids, kept = {r[0] for r in docs.select("doc_id").collect()}, {r[0] for r in out.select("doc_id").collect()}
        assert kept <= ids and (name not in ("secret_scan", "sentencepiece") or kept == ids)
        if name == "decontaminate":
            assert decontaminate.search(out, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
        before, docs = docs, out
    assert before is not None and docs.filter("n_tokens <> size(ids)").count() == 0 and docs.count() > 100


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


@pytest.fixture(scope="module")
def awkward(spark, edge_docs):
    """``edge_docs`` with columns of a stage's own names, nulls in all columns and a very long text."""
    long = ("the river runs past the old mill and on to the town " * 4000) + "end"
    extra = spark.createDataFrame([(20, long, None, None, None, None, None, None), (21, long, "en", "a", 1, 0.0, "", "")], edge_docs.schema)
    return edge_docs.unionByName(extra)


@pytest.mark.parametrize("at", range(5))
def test_stages_on_awkward_tables(spark, awkward, no_docs, at):
    """Nulls, empty and very long texts, repeated rows and clashing columns keep the schema and the rows they should; an empty table stays empty."""
    _, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, awkward, SF)
    assert set(awkward.columns) <= set(out.columns)
    rows = [r["doc_id"] for r in out.collect()]
    ids = [r["doc_id"] for r in awkward.select("doc_id").collect()]
    assert set(rows) <= set(ids)
    if at in (2, 3, 4):
        assert sorted(map(repr, rows)) == sorted(map(repr, ids))
    elif at == 0:
        assert {1, 2, 5, 20, 21} <= set(rows) and not {3, 4, 6} & set(rows) and rows.count(2) == 2
    else:
        assert {1, 20, 3} <= set(rows) and not {2, 21, 4, 6} & set(rows) and None in rows
    assert stage(spark, no_docs, SF).count() == 0
