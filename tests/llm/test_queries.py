"""The queries of this package that SQL can express, and the pipeline."""

import pytest

import corpus_pipeline
from ballast.llm import queries
from tests.oracle import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, name):
    check(spark, name, queries.QUERIES[name], queries.ORACLE[name], SF)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_rows(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert queries.QUERIES[name](spark, SF).count() >= docs


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names and 0 < docs.count() <= before
    assert {"doc_id", "bin", "size"} <= set(docs.columns)
