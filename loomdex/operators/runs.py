"""Evaluation runs: what is left to do, merging, errors, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex import fixed_values as fv
from loomdex.operators.ordering import first_in_order


def error_code(message: Column) -> Column:
    """The numeric code inside an error message, or null where there is none."""
    return F.nullif(F.regexp_extract(message, fv.ERROR_CODE, 1), F.lit("")).try_cast("bigint")


def short_message(message: Column) -> Column:
    return F.left(message, F.lit(fv.ERROR_MESSAGE_CHARS))


def is_quota_error(message: Column) -> Column:
    return F.contains(message, F.lit(fv.QUOTA_CODE)) | F.contains(
        F.lower(message), F.lit(fv.QUOTA_WORD)
    )


def is_transient_error(message: Column) -> Column:
    return F.rlike(message, F.lit("|".join(fv.TRANSIENT_CODES)))


def classified_errors(rows: DataFrame, id_col: str = "id", message: str = "message") -> DataFrame:
    text = F.coalesce(F.col(message), F.lit(""))
    return rows.select(
        id_col, error_code(text).alias("code"), short_message(text).alias("message"),
        is_quota_error(text).alias("quota"), is_transient_error(text).alias("transient"),
    )


def successes(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") == "success")


def completed_results(results: DataFrame, order: str) -> DataFrame:
    """The last successful row of each question, by ``order``.

    ``max_by`` combines before the shuffle, so a question with very many
    attempts arrives as one row per task.
    """
    fields = [c for c in results.columns if c != "id"]
    last = successes(results).groupBy("id").agg(
        F.max_by(F.struct(*fields), F.col(order)).alias("r")
    )
    return last.select("id", "r.*")


def remaining_questions(questions: DataFrame, results: DataFrame) -> DataFrame:
    """Questions without a successful result; failed ones are run again."""
    done = successes(results).select("id").distinct()
    return questions.join(done, "id", "left_anti")


def questions_from(questions: DataFrame, start: str) -> DataFrame:
    """Questions at or after an id, in ``position`` order; an unknown id is an error."""
    wanted = start.upper()
    found = questions.filter(F.col("id") == wanted).select("position").first()
    if found is None:
        raise ValueError(f"start question {wanted} does not exist")
    return questions.filter(F.col("position") >= found[0])


def next_questions(questions: DataFrame, results: DataFrame, start: str | None = None,
                   limit: int | None = None) -> DataFrame:
    """The work list of a run: from ``start``, not yet done, then at most ``limit``."""
    todo = questions_from(questions, start) if start else questions
    todo = remaining_questions(todo, results)
    if limit is not None:
        todo = first_in_order(todo, ["position"], limit)
    return todo


def merged_results(questions: DataFrame, previous: DataFrame, new: DataFrame,
                   order: str) -> DataFrame:
    """Completed results in question order, then the rows of this run.

    Earlier error rows drop out. Sort by ``is_new``, ``position`` when writing.
    """
    places = questions.select("id", "position")
    done = completed_results(previous, order).join(places, "id").withColumn("is_new", F.lit(0))
    fresh = new.join(places, "id").withColumn("is_new", F.lit(1))
    columns = [c for c in previous.columns if c in new.columns] + ["position", "is_new"]
    return done.select(*columns).unionByName(fresh.select(*columns))


def run_summary(questions: DataFrame, previous: DataFrame, new: DataFrame) -> DataFrame:
    """Total, previously done, successes and errors of this run, remaining."""
    done = successes(previous).select("id").distinct()
    counted = (
        questions.select(F.lit("q").alias("kind"))
        .unionByName(done.select(F.lit("done").alias("kind")))
        .unionByName(new.select(F.col("status").alias("kind")))
    )
    totals = counted.agg(
        F.count_if(F.col("kind") == "q").alias("total"),
        F.count_if(F.col("kind") == "done").alias("previously_done"),
        F.count_if(F.col("kind") == "success").alias("run_success"),
        F.count_if(F.col("kind") == "error").alias("run_errors"),
    )
    completed = F.col("previously_done") + F.col("run_success") + F.col("run_errors")
    return totals.withColumn("completed", completed).withColumn(
        "remaining", F.col("total") - F.col("completed")
    )


def evaluation_results(questions: DataFrame, records: DataFrame, failures: DataFrame) -> DataFrame:
    """Result rows of a run in the shape of ``schemas.RESULTS``.

    ``records`` are answer records; ``failures`` has id, message, elapsedMs for
    the questions whose run failed. A question has a row if it failed or was answered;
    one that was not run yet has none, so that it stays on the work list.
    """
    meta = ["id", "category", "scope", "question", "groundTruth", "expectedSource",
            "expectedSourceUrl"]
    joined = questions.select(*meta).join(records.drop("question"), "id", "left").join(
        failures.select("id", F.coalesce("message", F.lit("")).alias("message"), "elapsedMs"), "id", "left"
    )
    failed = F.col("message").isNotNull()
    joined = joined.filter(failed | F.col("answer").isNotNull())

    def unless_failed(column: str) -> Column:
        return F.when(~failed, F.col(column))

    def list_unless_failed(column: str) -> Column:
        empty = F.array().cast(records.schema[column].dataType)
        return F.when(failed, empty).otherwise(F.coalesce(F.col(column), empty))

    return joined.select(
        *meta,
        unless_failed("answer").alias("generatedAnswer"),
        unless_failed("insufficient").alias("insufficient"),
        list_unless_failed("retrievedSources").alias("retrievedSources"),
        list_unless_failed("citations").alias("citations"),
        unless_failed("retrievalMs").alias("retrievalLatencyMs"),
        unless_failed("generationMs").alias("generationLatencyMs"),
        F.when(failed, F.col("elapsedMs")).otherwise(F.col("totalMs")).cast("long")
        .alias("totalLatencyMs"),
        F.when(failed, "error").otherwise("success").alias("status"),
        F.when(failed, F.struct(
            error_code(F.col("message")).alias("code"),
            short_message(F.col("message")).alias("message"),
        )).alias("error"),
    )
