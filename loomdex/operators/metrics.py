"""Metrics over a table of evaluation results (``schemas.RESULTS``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex import fixed_values as fv
from loomdex.functions.text import keywords, rate, round_half_up


PHASES = ("retrieval", "generation", "total")


def _ids(column: str) -> Column:
    return F.transform(F.col(column), lambda c: c["documentId"])


def _success() -> Column:
    return F.coalesce(F.col("status") == "success", F.lit(False))


def _in_scope() -> Column:
    return _success() & (F.col("scope") == "in_scope")


def _out_of_scope() -> Column:
    return _success() & (F.col("scope") == "out_of_scope")


def is_hit(k: int, retrieved: str = "retrievedSources",
           expected: str = "expectedSource") -> Column:
    """Expected document among the first k chunks; repeated documents use up places."""
    first = F.slice(_ids(retrieved), 1, k)
    return F.coalesce(F.array_contains(first, F.col(expected)), F.lit(False))


def hit_flags(results: DataFrame, cutoffs: Sequence[int] = fv.HIT_CUTOFFS) -> DataFrame:
    """The result rows with one flag per cutoff."""
    return results.withColumns({f"hit{k}": is_hit(k) for k in cutoffs})


def overview(questions: DataFrame, results: DataFrame) -> DataFrame:
    rows = results.select("status", "scope", F.lit(1).alias("is_result")).unionByName(
        questions.select(F.lit(None).cast("string").alias("status"),
                         F.lit(None).cast("string").alias("scope"), F.lit(0).alias("is_result"))
    )
    counted = rows.agg(
        F.count_if(F.col("is_result") == 0).alias("total"),
        F.count_if(F.col("is_result") == 1).alias("completed"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "error").alias("failed"),
        F.count_if(_in_scope()).alias("in_scope_completed"),
        F.count_if(_out_of_scope()).alias("out_of_scope_completed"),
    )
    return counted.withColumn("skipped", F.col("total") - F.col("completed")).withColumn(
        "is_preliminary", F.col("completed") < F.col("total")
    )


def hit_rates(results: DataFrame, cutoffs: Sequence[int] = fv.HIT_CUTOFFS) -> DataFrame:
    """Raw and rounded Hit@K over successful in-scope results; null rates if none."""
    raw = results.agg(
        F.count_if(_in_scope()).alias("n"),
        *[F.count_if(_in_scope() & is_hit(k)).alias(f"hit{k}_raw") for k in cutoffs],
    )
    return raw.select(
        "*", *[rate(F.col(f"hit{k}_raw"), F.col("n")).alias(f"hit{k}") for k in cutoffs]
    )


def _answered() -> Column:
    return _in_scope() & F.coalesce(~F.col("insufficient"), F.lit(False))


def _citation_share() -> Column:
    """Share of a row's citations that were retrieved; null if it cites nothing."""
    cited, found = _ids("citations"), _ids("retrievedSources")
    valid = F.filter(cited, lambda d: F.coalesce(F.array_contains(found, d), F.lit(False)))
    return F.when(_answered() & (F.size(cited) > 0), F.size(valid) / F.size(cited))


def _covered() -> Column:
    return F.coalesce(F.array_contains(_ids("citations"), F.col("expectedSource")), F.lit(False))


def _rightly_refused() -> Column:
    return F.coalesce(F.col("insufficient"), F.lit(False)) & (
        F.coalesce(F.size("citations"), F.lit(0)) <= 0
    )


def citation_precision(results: DataFrame) -> DataFrame:
    """Mean share of citations that were retrieved, over answered rows that cite anything."""
    share = _citation_share()
    return results.agg(
        round_half_up(F.avg(share)).alias("precision"), F.count(share).alias("rows_with_citations")
    )


def citation_coverage(results: DataFrame) -> DataFrame:
    """Share of answered in-scope rows that cite the expected document."""
    counted = results.agg(
        F.count_if(_answered() & _covered()).alias("coverage_hits"),
        F.count_if(_answered()).alias("answered"),
    )
    return counted.withColumn("coverage", rate(F.col("coverage_hits"), F.col("answered")))


def out_of_scope_rate(results: DataFrame) -> DataFrame:
    """Share of out-of-scope rows handled rightly: insufficient and without citations."""
    counted = results.agg(
        F.count_if(_out_of_scope() & _rightly_refused()).alias("correct"),
        F.count_if(_out_of_scope()).alias("total"),
    )
    return counted.withColumn("rate", rate(F.col("correct"), F.col("total")))


def answer_score(rows: DataFrame, answer: str = "generatedAnswer",
                 truth: str = "groundTruth") -> DataFrame:
    """Add hits, total, score and label of the keyword overlap with the ground truth.

    The label is decided on the unrounded share.
    """
    wanted = keywords(F.col(truth))
    given = keywords(F.coalesce(F.col(answer), F.lit("")))
    found = rows.withColumns({"__wanted": wanted, "__given": given}).withColumns({
        "hits": F.size(F.array_intersect("__wanted", "__given")),
        "total": F.size("__wanted"),
    }).drop("__wanted", "__given")
    share = F.col("hits") / F.col("total")
    correct, partial, incorrect, review = fv.ANSWER_LABELS
    label = (
        F.when(F.col("total") <= 0, review)
        .when(share >= fv.CORRECT_FROM, correct)
        .when(share >= fv.PARTIAL_FROM, partial)
        .otherwise(incorrect)
    )
    return found.withColumn("score", F.when(F.col("total") > 0, round_half_up(share))).withColumn(
        "label", label
    )


def answer_labels(results: DataFrame) -> DataFrame:
    """Per successful in-scope question: label, score, hits, total.

    An answer that calls the context insufficient needs a manual review.
    """
    return _labelled(results.filter(_in_scope()))


def _labelled(results: DataFrame) -> DataFrame:
    scored = answer_score(results)
    lacking = F.coalesce(F.col("insufficient"), F.lit(False))
    return scored.withColumns({
        "label": F.when(lacking, fv.ANSWER_LABELS[3]).otherwise(F.col("label")),
        "score": F.when(~lacking, F.col("score")),
        "hits": F.when(~lacking & (F.col("total") > 0), F.col("hits")),
        "total": F.when(~lacking & (F.col("total") > 0), F.col("total")),
    })


def answer_quality(results: DataFrame) -> DataFrame:
    """All four labels with count and rate, zeros included."""
    counted = answer_labels(results).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("label") == name).alias(name) for name in fv.ANSWER_LABELS],
    )
    rows = F.array(*[
        F.struct(F.lit(name).alias("label"), F.col(name).alias("n")) for name in fv.ANSWER_LABELS
    ])
    return counted.select("total", F.inline(rows)).select(
        "label", "n", "total", rate(F.col("n"), F.col("total")).alias("rate")
    )


def value_stats(values: DataFrame, group: str, value: str) -> DataFrame:
    """Count, average, exact p50 and p95 (linear interpolation), min, max per group.

    Values are counted per (group, value) first. Latencies are whole milliseconds,
    so what reaches a group's task is bounded by the range of values and not by
    the number of rows; a group holding most rows is no hot spot.
    """
    counted = values.filter(F.col(value).isNotNull()).groupBy(group, value).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.groupBy(group).agg(
        F.sum("n").alias("n"),
        round_half_up(F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("avg"),
        round_half_up(F.percentile(F.col(value), F.lit(0.5), F.col("n"))).alias("p50"),
        round_half_up(F.percentile(F.col(value), F.lit(0.95), F.col("n"))).alias("p95"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )


def latency_stats(results: DataFrame) -> DataFrame:
    """Statistics per phase over successful results, nulls left out."""
    phases = results.filter(_success()).select(F.inline(F.array(*[
        F.struct(F.lit(phase).alias("phase"), F.col(f"{phase}LatencyMs").alias("ms"))
        for phase in PHASES
    ])))
    return value_stats(phases, "phase", "ms")


def per_category(results: DataFrame) -> DataFrame:
    """Per category: questions, Hit@5 raw and rate, count of every label."""
    labelled = answer_labels(results)
    counted = labelled.groupBy("category").agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(is_hit(5)).alias("hit5_raw"),
        *[F.count_if(F.col("label") == name).alias(name) for name in fv.ANSWER_LABELS],
    )
    return counted.withColumn("hit5", rate(F.col("hit5_raw"), F.col("questions")))


def metrics_long(questions: DataFrame, results: DataFrame) -> DataFrame:
    """The numbers of the metrics report as (section, metric, value, raw) rows.

    ``raw`` is "count/of" where the value is a rate. The results are read once: each
    gives a row for its category and one per phase with a latency, which are counted per
    (category or phase, millisecond) before anything else; all numbers are sums of these.
    """
    hits = [f"hit{k}" for k in fv.HIT_CUTOFFS]
    flags = {
        "completed": F.lit(True), "successful": _success(), "failed": F.col("status") == "error",
        "in_scope_completed": _in_scope(), "out_of_scope_completed": _out_of_scope(),
        "answered": _answered(), "coverage_hits": _answered() & _covered(),
        "out_of_scope_correct": _out_of_scope() & _rightly_refused(),
        **{f"hit{k}_raw": _in_scope() & is_hit(k) for k in fv.HIT_CUTOFFS},
        **{name: _in_scope() & (F.col("label") == name) for name in fv.ANSWER_LABELS},
    }
    flagged = _labelled(results).select(
        "category", *[flag.alias(name) for name, flag in flags.items()],
        _citation_share().alias("share"),
        *[F.when(_success(), F.col(f"{p}LatencyMs")).cast("long").alias(p) for p in PHASES],
    )
    kinds = F.array(
        F.struct(F.lit("category").alias("kind"), F.col("category").alias("key"),
                 F.lit(None).cast("long").alias("ms")),
        *[F.struct(F.lit("latency").alias("kind"), F.lit(p).alias("key"), F.col(p).alias("ms"))
          for p in PHASES],
    )
    own = F.col("kind") == "category"
    counted = flagged.select("*", F.inline(kinds)).filter(own | F.col("ms").isNotNull()).groupBy(
        "kind", "key", "ms").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(own & F.col(name)).alias(name) for name in flags],
        F.sum(F.when(own, F.col("share"))).alias("share"),
        F.count(F.when(own, F.col("share"))).alias("cited"),
    )
    asked = questions.agg(F.count(F.lit(1)).alias("asked")).select(
        F.lit("questions").alias("kind"), F.lit(None).cast("string").alias("key"), "asked",
        F.lit(0).cast("long").alias("n"),
    )

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).alias(name)

    sums = counted.unionByName(asked, allowMissingColumns=True).groupingSets(
        [[F.col("kind"), F.col("key")], []], F.col("kind"), F.col("key")).agg(
        F.grouping_id().alias("level"), total("asked"), total("n"), *[total(f) for f in flags],
        round_half_up(F.try_divide(F.sum("share"), F.sum("cited"))).alias("precision"),
        round_half_up(F.try_divide(F.sum(F.col("ms") * F.col("n")), F.sum("n"))).alias("avg"),
        round_half_up(F.percentile("ms", F.lit(0.5), F.col("n"))).alias("p50"),
        round_half_up(F.percentile("ms", F.lit(0.95), F.col("n"))).alias("p95"),
        F.min("ms").alias("min"), F.max("ms").alias("max"),
    )

    def cell(section: str, metric: str, value: str | Column, of: str | None = None,
             prefix: Column | None = None) -> Column:
        value = F.col(value) if isinstance(value, str) else value
        raw = F.lit(None).cast("string") if of is None else F.concat(
            value.cast("string"), F.lit("/"), F.col(of).cast("string"))
        name = F.lit(metric) if prefix is None else F.concat(prefix, F.lit("." + metric))
        return F.struct(
            F.lit(section).alias("section"), name.alias("metric"),
            (value if of is None else rate(value, F.col(of))).cast("double").alias("value"),
            raw.alias("raw"))

    everything = [
        cell("overview", "total", "asked"),
        *[cell("overview", c, c) for c in ("completed", "successful", "failed",
                                           "in_scope_completed", "out_of_scope_completed")],
        cell("overview", "skipped", F.col("asked") - F.col("completed")),
        cell("retrieval", "n", "in_scope_completed"),
        *[cell("retrieval", h, f"{h}_raw", "in_scope_completed") for h in hits],
        *[cell("retrieval", f"{h}_raw", f"{h}_raw") for h in hits],
        cell("citation", "precision", "precision"),
        cell("citation", "coverage", "coverage_hits", "answered"),
        cell("citation", "coverage_hits", "coverage_hits"), cell("citation", "answered", "answered"),
        cell("citation", "out_of_scope_rate", "out_of_scope_correct", "out_of_scope_completed"),
        cell("citation", "out_of_scope_correct", "out_of_scope_correct"),
        cell("citation", "out_of_scope_total", "out_of_scope_completed"),
        *[cell("answers", f"{name}.n", name) for name in fv.ANSWER_LABELS],
        *[cell("answers", f"{name}.rate", name, "in_scope_completed") for name in fv.ANSWER_LABELS],
    ]
    key = F.col("key")
    latency = [cell("latency", c, c, prefix=key) for c in ("n", "avg", "p50", "p95", "min", "max")]
    category = [
        cell("category", "questions", "in_scope_completed", prefix=key),
        cell("category", "hit5", "hit5_raw", "in_scope_completed", key),
        *[cell("category", c, c, prefix=key) for c in ("hit5_raw", *fv.ANSWER_LABELS)],
    ]
    chosen = (
        F.when(F.col("level") > 0, F.array(*everything))
        .when(F.col("kind") == "latency", F.array(*latency))
        .when((F.col("kind") == "category") & (F.col("in_scope_completed") > 0), F.array(*category))
    )
    return sums.select(F.inline(chosen))
