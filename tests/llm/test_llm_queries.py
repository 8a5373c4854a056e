"""The numbered queries over the given tables, and the pipeline's stages."""

import os

import pytest
from compare import difference, duck

import corpus_pipeline
from loomdex.llm.queries import QUERIES, SQL

FOLDER = os.environ.get("LOOMDEX_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_result_as_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), duck(FOLDER), SQL[name]) is None


def test_pipeline_keeps_columns_and_shrinks(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER).cache()
        if name != "bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
        assert 0 < docs.count() <= before
        before = docs.count()
    assert {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()} == {
        r.doc_id for r in docs.collect()}
