"""Corpus jobs: selection, manifest, cleaning with rejects, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex import fixed_values as fv
from loomdex.functions.markup import clean_markup, first_line_title
from loomdex.functions.text import round_half_up, trimmed


def missing_documents(selection: DataFrame, corpus: DataFrame, key: str = "id") -> DataFrame:
    """Selected documents that the corpus does not have."""
    return selection.join(corpus.select(key), key, "left_anti")


def selected_documents(selection: DataFrame, corpus: DataFrame, key: str = "id") -> DataFrame:
    """Selected documents that are there, with their text."""
    return selection.join(corpus, key)


def short_source(text: Column) -> Column:
    """Flag for a suspiciously short raw text; such a document is still kept."""
    return F.length(trimmed(text)) < fv.SHORT_SOURCE_CHARS


def corpus_manifest(selected: DataFrame, source: str, text: str = "text",
                    folder: str = "data/raw") -> DataFrame:
    """One manifest row per selected document, with line and character counts.

    ``selected`` has id, title, url, category and the text.
    """
    return selected.select(
        "id", "title", F.lit(source).alias("source"), F.col("url").alias("sourceUrl"),
        F.concat(F.lit(folder + "/"), F.col("id"), F.lit(".txt")).alias("file"), "category",
        F.size(F.split(F.col(text), "\n", -1)).alias("lines"),
        F.length(text).alias("chars"),
        short_source(F.col(text)).alias("short"),
    )


def saved_manifest(manifest: DataFrame) -> DataFrame:
    """The manifest as stored: without the counts that only serve the report."""
    return manifest.drop("lines", "chars", "short")


def corpus_report(selection: DataFrame, manifest: DataFrame, key: str = "id") -> DataFrame:
    """Selected, copied, missing, short, total and average characters, size gate."""
    flagged = selection.select(key).join(
        manifest.select(key, "chars", "short", F.lit(True).alias("found")), key, "left"
    )
    return flagged.agg(
        F.count(F.lit(1)).alias("selected"),
        F.count("found").alias("copied"),
        F.count_if(F.col("found").isNull()).alias("missing"),
        F.count_if(F.col("short")).alias("short"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("total_chars"),
        round_half_up(F.avg("chars"), 0).cast("long").alias("average_chars"),
        (F.count("found") >= fv.MIN_CORPUS_DOCUMENTS).alias("enough"),
    )


def clean_corpus(raw: DataFrame, manifest: DataFrame, source: str | None = None) -> DataFrame:
    """Every raw document with its cleaned text and, where it fails, the reason.

    ``raw`` has id and text; ``manifest`` has the fields of ``schemas.MANIFEST``.
    The result feeds :func:`parsed_documents` and :func:`parse_rejects`, so both
    come from one pass when it is written once.
    """
    meta = manifest.withColumn("__known", F.lit(True))
    joined = raw.select(F.col("id"), F.col("text").alias("rawText")).join(meta, "id", "left")
    # documents without a manifest entry are rejected before any cleaning work
    cleaned = F.when(F.col("__known"), clean_markup(F.col("rawText")))

    def judged(text: Column) -> Column:
        reason = F.when(F.col("__known").isNull(), "no manifest entry").when(
            text == "", "empty after cleaning")
        return F.struct(text.alias("text"), reason.alias("reason"))

    # a generated row: a filter on the reason stays above it, so that cleaning runs once
    return (
        joined.select("*", F.inline(F.transform(F.array(cleaned), judged)))
        .withColumn("source", F.lit(source) if source else F.col("source"))
        .withColumn("file", F.coalesce("file", F.concat("id", F.lit(".txt"))))
        .drop("__known")
    )


def parsed_documents(cleaned: DataFrame) -> DataFrame:
    """The eight-column document records; the manifest title wins."""
    return cleaned.filter(F.col("reason").isNull()).select(
        F.col("id").alias("documentId"), "title",
        first_line_title(F.col("text"), F.col("title")).alias("extractedTitle"),
        "source", "sourceUrl", "category", F.col("file").alias("originalFile"), "text",
    )


def parse_rejects(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter(F.col("reason").isNotNull()).select("file", "reason")


def parse_report(cleaned: DataFrame) -> DataFrame:
    """Raw, processed, failed and short counts; lengths with their documents."""
    length = F.when(F.col("reason").isNull(), F.length("text"))
    lengths = cleaned.select(F.col("id"), length.alias("chars"))
    # smallest id among equal lengths, so that the answer does not depend on row order
    shortest = F.min(F.when(F.col("chars").isNotNull(), F.struct("chars", "id")))
    longest = F.min(F.when(F.col("chars").isNotNull(), F.struct(-F.col("chars"), "id")))
    report = lengths.agg(
        F.count(F.lit(1)).alias("raw"),
        F.count("chars").alias("processed"),
        F.count_if(F.col("chars").isNull()).alias("failed"),
        F.count_if(F.col("chars") < fv.SHORT_DOCUMENT_CHARS).alias("short"),
        round_half_up(F.avg("chars"), 0).cast("long").alias("average_chars"),
        shortest.alias("shortest"),
        F.max("chars").alias("max_chars"),
        longest.alias("longest"),
    )
    return report.select(
        "raw", "processed", "failed", "short", "average_chars",
        F.col("shortest.chars").alias("min_chars"), F.col("shortest.id").alias("min_id"),
        "max_chars", F.col("longest.id").alias("max_id"),
        (F.col("processed") >= fv.MIN_CORPUS_DOCUMENTS).alias("enough"),
    )


def cleaning_effect(cleaned: DataFrame) -> DataFrame:
    """Per document: characters before and after, reduction in percent, preview."""
    kept = cleaned.filter(F.col("reason").isNull())
    share = F.lit(1.0) - F.length("text") / F.length("rawText")
    preview = F.regexp_replace(F.left(F.col("text"), F.lit(fv.PREVIEW_CHARS)), "\n+", " ")
    return kept.select(
        F.col("id").alias("documentId"),
        F.length("rawText").alias("raw_chars"), F.length("text").alias("clean_chars"),
        round_half_up(share * 100, 0).cast("long").alias("reduction_percent"),
        preview.alias("preview"),
    )
