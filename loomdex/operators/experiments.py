"""Comparing chunking configurations on the same questions.

All jobs take per-question rows as in ``schemas.RETRIEVAL_RESULTS`` with an
``experiment`` column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex import fixed_values as fv
from loomdex.functions.text import rate, round_half_up
from loomdex.operators.answers import source_summaries
from loomdex.operators.metrics import hit_flags, is_hit


def select_experiment(config: DataFrame, experiment: str) -> DataFrame:
    """The configuration row of one experiment; an unknown id is an error."""
    chosen = config.filter(F.col("id") == experiment)
    if chosen.limit(1).count() == 0:
        known = [r["id"] for r in config.select("id").orderBy("id").collect()]
        raise ValueError(f"unknown experiment {experiment!r}, there are {known}")
    return chosen


def retrieval_results(questions: DataFrame, retrieved: DataFrame, experiment: str, *,
                      latencies: DataFrame | None = None) -> DataFrame:
    """Per in-scope question: retrieved chunks, hit flags, latency, error.

    ``retrieved`` has one row per question with the list ``retrieved``;
    ``latencies`` has id, latencyMs, error.
    """
    in_scope = questions.filter(F.col("scope") == "in_scope").select(
        "id", "category", "question", "expectedSource"
    )
    joined = in_scope.join(retrieved.withColumnRenamed("queryId", "id"), "id", "left")
    if latencies is not None:
        joined = joined.join(latencies.select("id", "latencyMs", "error"), "id", "left")
    else:
        joined = joined.withColumns({
            "latencyMs": F.lit(None).cast("long"), "error": F.lit(None).cast("string"),
        })
    sources = source_summaries(F.col("retrieved"))
    empty = F.filter(sources, lambda s: F.lit(False))
    listed = F.when(F.col("error").isNull(), sources).otherwise(empty)
    rows = joined.withColumn("retrievedSources", listed)
    return hit_flags(rows).select(
        F.lit(experiment).alias("experiment"), "id", "category", "question", "expectedSource",
        "retrievedSources", *[f"hit{k}" for k in fv.HIT_CUTOFFS], "latencyMs", "error",
    )


def retrieval_evaluation(rows: DataFrame) -> DataFrame:
    """Per experiment: questions, successes, hits, rates over both denominators, latency.

    Rows are counted per (experiment, latency) first, so one pass over the rows
    gives everything and an experiment's task sees distinct latencies only.
    """
    hits = [f"hit{k}" for k in fv.HIT_CUTOFFS]
    ok = F.col("error").isNull()
    counted = rows.groupBy("experiment", F.when(ok, F.col("latencyMs")).alias("ms")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("ok"),
        *[F.count_if(F.col(h)).alias(h) for h in hits],
    )
    timed = F.when(F.col("ms").isNotNull(), F.col("n"))
    totals = counted.groupBy("experiment").agg(
        F.sum("n").alias("total"), F.sum("ok").alias("success"),
        *[F.sum(h).alias(f"{h}_raw") for h in hits],
        round_half_up(F.sum(F.col("ms") * F.col("n")) / F.sum(timed)).alias("latency_avg"),
        round_half_up(F.percentile("ms", F.lit(0.5), F.col("n"))).alias("latency_p50"),
        round_half_up(F.percentile("ms", F.lit(0.95), F.col("n"))).alias("latency_p95"),
        F.min("ms").alias("latency_min"), F.max("ms").alias("latency_max"),
    )
    return totals.select(
        "*",
        *[rate(F.col(f"{h}_raw"), F.col("success")).alias(h) for h in hits],
        *[rate(F.col(f"{h}_raw"), F.col("total")).alias(f"{h}_of_total") for h in hits],
    )


def misses(rows: DataFrame) -> DataFrame:
    """Questions whose expected document is not in the top five."""
    top = F.coalesce(F.get(F.col("retrievedSources"), F.lit(0))["documentId"], F.lit("none"))
    return rows.filter(~F.col("hit5")).select(
        "experiment", "id", F.left(F.col("question"), F.lit(fv.MISS_QUESTION_CHARS)).alias("question"),
        "expectedSource", top.alias("top_document"),
    )


def _pivoted(long: DataFrame, keys: Sequence[str], experiments: Sequence[str],
             value: str) -> DataFrame:
    return long.groupBy(*keys).pivot("experiment", list(experiments)).agg(F.max(value))


def compare_metrics(evaluated: DataFrame, experiments: tuple[str, str]) -> DataFrame:
    """Hit rates and latencies side by side.

    The difference is first minus second: percentage points of the exact hit
    shares, or milliseconds.
    """
    hits = [f"hit{k}" for k in fv.HIT_CUTOFFS]
    cells = F.array(*[
        F.struct(F.lit(h).alias("metric"), (F.col(f"{h}_raw") / F.col("total") * 100).alias("value"))
        for h in hits
    ], *[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
        for c in ("latency_avg", "latency_p50", "latency_p95")
    ])
    first, second = experiments
    wide = _pivoted(evaluated.select("experiment", F.inline(cells)), ["metric"], experiments, "value")
    return wide.select(
        "metric", round_half_up(F.col(f"`{first}`"), 1).alias("first"),
        round_half_up(F.col(f"`{second}`"), 1).alias("second"),
        round_half_up(F.col(f"`{first}`") - F.col(f"`{second}`"), 1).alias("difference"),
    )


def compare_categories(rows: DataFrame, experiments: tuple[str, str]) -> DataFrame:
    """Hit@5, raw and rate, per category and experiment."""

    def of(experiment: str) -> Column:
        return F.col("experiment") == experiment

    first, second = experiments
    counted = rows.groupBy("category").agg(
        F.count_if(of(first)).alias("questions"),
        F.count_if(of(first) & F.col("hit5")).alias("first_hit5_raw"),
        F.count_if(of(second)).alias("__second"),
        F.count_if(of(second) & F.col("hit5")).alias("second_hit5_raw"),
    )
    return counted.select(
        "category", "questions", "first_hit5_raw",
        rate(F.col("first_hit5_raw"), F.col("questions")).alias("first_hit5"),
        "second_hit5_raw", rate(F.col("second_hit5_raw"), F.col("__second")).alias("second_hit5"),
    )


def flips(rows: DataFrame, experiments: tuple[str, str]) -> DataFrame:
    """Questions whose Hit@1 or Hit@5 differs between two experiments.

    A question that failed in one of them is no flip: its ranking is not known.
    """
    def of(experiment: str, flag: str) -> Column:
        return F.max(F.when(F.col("experiment") == experiment, F.col(flag)))

    first, second = experiments
    both = rows.filter(F.col("error").isNull()).groupBy("id").agg(
        of(first, "hit1").alias("first_hit1"), of(first, "hit5").alias("first_hit5"),
        of(second, "hit1").alias("second_hit1"), of(second, "hit5").alias("second_hit5"),
    )
    return both.filter(
        (F.col("first_hit1") != F.col("second_hit1"))
        | (F.col("first_hit5") != F.col("second_hit5"))
    )


def score_margins(rows: DataFrame) -> DataFrame:
    """Rank and best score of the expected document, and its distance to rank 1."""
    expected = F.filter("retrievedSources", lambda c: c["documentId"] == F.col("expectedSource"))
    place = F.array_position(
        F.transform("retrievedSources", lambda c: c["documentId"]), F.col("expectedSource")
    )
    top = F.get(F.col("retrievedSources"), F.lit(0))
    best = F.array_max(F.transform(expected, lambda c: c["score"]))
    return rows.select(
        "experiment", "id", "expectedSource",
        top["documentId"].alias("top_document"), top["score"].alias("top_score"),
        F.when(place > 0, place).alias("expected_rank"),
        best.alias("expected_score"), (top["score"] - best).alias("margin"),
    )


def failure_class(rows: DataFrame) -> DataFrame:
    """Per experiment: how many questions hit at rank 1, rank below, miss, or failed (error)."""
    kind = (
        F.when(F.col("error").isNotNull(), "error").when(is_hit(1), "hit").when(is_hit(5), "ranked_below").otherwise("total_miss")
    )
    return rows.groupBy("experiment", kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def top_k_dominance(rows: DataFrame) -> DataFrame:
    """Per question: the largest number of top chunks that come from one document.

    The smallest document id wins among equals. Lists have at most k items, so
    everything happens inside the row.
    """
    documents = F.transform("retrievedSources", lambda c: c["documentId"])
    counts = F.transform(F.array_distinct(documents), lambda d: F.struct(
        (-F.size(F.filter(documents, lambda x: x == d))).alias("n"), d.alias("documentId")
    ))
    lead = F.array_min(counts)
    return rows.select(
        "experiment", "id", F.size("retrievedSources").alias("retrieved"),
        lead["documentId"].alias("documentId"), (-lead["n"]).alias("chunks"),
    ).filter(F.col("retrieved") > 0)


def unknown_sources(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """In-scope questions whose expected document does not exist."""
    wanted = questions.filter(F.col("scope") == "in_scope").select("id", "expectedSource")
    known = documents.select(F.col("documentId").alias("expectedSource"))
    return wanted.join(known, "expectedSource", "left_anti").select("id", "expectedSource")


def question_distribution(questions: DataFrame) -> DataFrame:
    """Questions per category and scope, with a total row."""
    counted = questions.rollup("category").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("scope") == "in_scope").alias("in_scope"),
        F.count_if(F.col("scope") == "out_of_scope").alias("out_of_scope"),
        F.grouping("category").alias("is_total"),
    )
    return counted.select(
        F.when(F.col("is_total") == 1, "Total").otherwise(F.col("category")).alias("category"),
        "n", "in_scope", "out_of_scope",
    )
