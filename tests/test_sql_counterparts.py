"""Spark results against DuckDB on the given tables.

All queries are compared when LOOMDEX_ALL_QUERIES is set; otherwise one query
per area, because retrieval runs anew in each of the others.
"""

import os

import pytest
from compare import difference, duck

from loomdex.plans.table_queries import QUERIES
from sql_counterparts import SQL

FOLDER = os.environ.get("LOOMDEX_TABLES", "/root/testdata/sf0.001")
ONE_PER_AREA = (
    "corpus_report", "clean_corpus", "parse_report", "clean_collapse", "chunk_rows",
    "chunk_overlap_check", "embed_hashed", "embed_failures", "validate_input", "upsert_chunks",
    "topk_cosine", "retrieve_all", "citations", "case_check", "merge_results", "error_class",
    "evaluation_results", "answer_score", "latency_events", "metrics_long", "exp_compare",
    "score_margin", "question_dist",
)
NAMES = sorted(SQL) if os.environ.get("LOOMDEX_ALL_QUERIES") else ONE_PER_AREA


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_same_result(spark, connection, name):
    assert difference(QUERIES[name](spark, FOLDER), connection, SQL[name]) is None


def test_every_counterpart_has_a_query():
    assert set(SQL) <= set(QUERIES)
