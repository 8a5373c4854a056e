"""A question table from retrieval to prompts, and from answers to results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex import fixed_values as fv
from loomdex.functions.vectors import Embedder
from loomdex.operators.answers import (
    answer_records,
    context_text,
    prompt_text,
    retrieved_lists,
)
from loomdex.operators.retrieval import retrieve
from loomdex.operators.runs import evaluation_results


def prompts(questions: DataFrame, embedded_chunks: DataFrame, embedder: Embedder,
            instructions: str, k: int = fv.TOP_K) -> DataFrame:
    """id and prompt of every question that has any context, for a generation model."""
    lists = retrieved_lists(retrieve(embedded_chunks, questions, embedder, k))
    asked = questions.select(F.col("id").alias("queryId"), "question")
    prompt = prompt_text(instructions, context_text(F.col("retrieved")), F.col("question"))
    return lists.join(asked, "queryId").select(F.col("queryId").alias("id"), prompt.alias("prompt"))


def run_results(questions: DataFrame, retrieved: DataFrame, answers: DataFrame,
                failures: DataFrame, no_context_answer: str,
                unembedded: DataFrame | None = None) -> DataFrame:
    """Result rows (``schemas.RESULTS``) of a run whose answers have come back.

    ``answers``: id, answer, retrievalMs, generationMs; ``failures``: id, message,
    elapsedMs. ``unembedded``, in the same shape, are the questions without a vector, which
    :func:`~loomdex.operators.retrieval.searched` lists: they are errors too, unless
    ``failures`` has them already. A question with chunks and no answer has no row.
    """
    if unembedded is not None:
        columns = ["id", "message", "elapsedMs"]
        others = unembedded.join(failures.select("id"), "id", "left_anti")
        failures = failures.select(*columns).unionByName(others.select(*columns))
    records = answer_records(questions, retrieved, answers, no_context_answer)
    return evaluation_results(questions, records, failures)
