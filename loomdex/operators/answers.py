"""From retrieved chunks and answers to contexts, citations and answer records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from loomdex import fixed_values as fv
from loomdex.functions.text import is_blank
from loomdex.schemas import CITATION

_SOURCE_FIELDS = ("chunkId", "documentId", "title", "sourceUrl", "score")


def retrieved_lists(retrieved: DataFrame, query_id: str = "queryId") -> DataFrame:
    """One row per question with its chunks in rank order (k rows per question)."""
    fields = [c for c in retrieved.columns if c not in (query_id, "rank")]
    return retrieved.groupBy(query_id).agg(
        F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("retrieved")
    )


def context_text(retrieved: Column) -> Column:
    """Numbered source blocks in rank order."""
    before_rank, rest = fv.CONTEXT_ITEM.split("{rank}")
    before_title, before_text = rest.replace("{text}", "").split("{title}")

    def item(chunk: Column, index: Column) -> Column:
        return F.concat(
            F.lit(before_rank), (index + 1).cast("string"), F.lit(before_title),
            chunk["title"], F.lit(before_text), chunk["text"],
        )

    return F.array_join(F.transform(retrieved, item), fv.CONTEXT_SEPARATOR)


def prompt_text(instructions: str, context: Column, question: Column) -> Column:
    """Instructions, context and question under their headings."""
    return F.concat(
        F.lit(f"{instructions}\n\n{fv.CONTEXT_HEADING}\n"), context,
        F.lit(f"\n\n{fv.QUESTION_HEADING}\n"), question,
    )


def citation_list(retrieved: Column) -> Column:
    """Best-scoring chunk of each document, best document first."""
    ordered = F.array_sort(F.transform(retrieved, lambda c: F.struct(
        (-c["score"]).alias("low_first"), c["rank"].alias("rank"), c["title"].alias("title"),
        c["sourceUrl"].alias("sourceUrl"), c["documentId"].alias("documentId"),
        c["score"].alias("score"),
    )))
    documents = F.transform(ordered, lambda c: c["documentId"])
    numbered = F.transform(ordered, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    firsts = F.filter(
        numbered, lambda n: F.array_position(documents, n["c"]["documentId"]) == n["i"] + 1
    )
    return F.transform(firsts, lambda n: F.struct(
        *[n["c"][f].alias(f) for f in ("title", "sourceUrl", "documentId", "score")]
    ))


def citations(retrieved: DataFrame, query_id: str = "queryId") -> DataFrame:
    """Citations as rows: query id, place, title, sourceUrl, documentId, score."""
    lists = retrieved_lists(
        retrieved.select(query_id, "rank", "documentId", "title", "sourceUrl", "score"), query_id
    )
    return lists.select(
        query_id, F.posexplode(citation_list(F.col("retrieved"))).alias("at", "c")
    ).select(query_id, (F.col("at") + 1).alias("place"), "c.*")


def is_insufficient(answer: Column, phrase: str = fv.INSUFFICIENT_PHRASE) -> Column:
    return F.contains(F.lower(answer), F.lit(phrase.lower()))


def source_summaries(retrieved: Column) -> Column:
    """Retrieved chunks without their text."""
    return F.transform(retrieved, lambda c: F.struct(*[c[f].alias(f) for f in _SOURCE_FIELDS]))


def answer_records(questions: DataFrame, retrieved: DataFrame, answers: DataFrame,
                   no_context_answer: str, *, query_id: str = "queryId") -> DataFrame:
    """One answer record per question that is answered.

    ``answers`` has id, answer, retrievalMs, generationMs. A question without
    any chunk gets the fixed answer, counts as insufficient and has no
    generation time; an insufficient answer has no citations. A question that has chunks
    and no answer has no record: it was not run to its end.
    """
    lists = retrieved_lists(retrieved, query_id).withColumnRenamed(query_id, "id")
    joined = (
        questions.filter(~is_blank(F.col("question"))).select("id", "question")
        .join(lists, "id", "left").join(answers, "id", "left")
    )
    return assembled_records(joined, no_context_answer)


def assembled_records(joined: DataFrame, no_context_answer: str) -> DataFrame:
    """Answer records from rows that already hold everything about a question:
    id, question, ``retrieved`` list, answer, retrievalMs, generationMs. Rows with chunks
    and without an answer make none."""
    nothing = F.col("retrieved").isNull()
    answer = F.when(nothing, F.lit(no_context_answer)).otherwise(F.col("answer"))
    generation = F.when(nothing, F.lit(0)).otherwise(F.col("generationMs"))
    lacking = nothing | is_insufficient(F.col("answer"))
    cited = citation_list(F.col("retrieved"))
    return joined.withColumns({
        "answer": answer,
        "insufficient": lacking,
        "generationMs": generation.cast("long"),
    }).filter(F.col("answer").isNotNull()).select(
        "id", "question", "answer",
        F.coalesce(
            F.when(~F.col("insufficient"), cited), F.array().cast(ArrayType(CITATION))
        ).alias("citations"),
        source_summaries(F.col("retrieved")).alias("retrievedSources"),
        "insufficient",
        F.col("retrievalMs").cast("long").alias("retrievalMs"), "generationMs",
        (F.col("retrievalMs") + F.col("generationMs")).cast("long").alias("totalMs"),
    )


PUBLIC_FIELDS = ("answer", "citations", "insufficient", "retrievalMs", "generationMs", "totalMs")


def public_response(records: DataFrame) -> DataFrame:
    """The six fields of a record that a caller sees."""
    return records.select(*PUBLIC_FIELDS)


def answer_lines(answers: DataFrame, id_col: str = "id", answer: str = "answer") -> DataFrame:
    """Non-blank lines of each answer, numbered."""
    lines = F.filter(F.split(F.col(answer), "\n", -1), lambda line: ~is_blank(line))
    return answers.select(id_col, F.posexplode(lines).alias("at", "line")).select(
        id_col, (F.col("at") + 1).alias("line_no"), "line"
    )


def ungrounded_citations(records: DataFrame) -> DataFrame:
    """Cited URLs that none of the record's retrieved chunks has."""
    known = F.transform("retrievedSources", lambda c: c["sourceUrl"])
    urls = F.transform("citations", lambda c: c["sourceUrl"])
    stray = F.filter(urls, lambda u: ~F.coalesce(F.array_contains(known, u), F.lit(False)))
    return records.select("id", F.explode(stray).alias("sourceUrl"))


def repeated_citations(records: DataFrame) -> DataFrame:
    """Documents cited again within one record, once per repetition."""
    ids = F.transform("citations", lambda c: c["documentId"])
    numbered = F.transform(ids, lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    again = F.filter(numbered, lambda n: F.array_position(ids, n["d"]) < n["i"] + 1)
    return records.select("id", F.explode(again).alias("r")).select(
        "id", F.col("r.d").alias("documentId")
    )


def case_failures(records: DataFrame, cases: DataFrame) -> DataFrame:
    """Every record against its case: list of failures and whether it passed.

    ``cases`` has id and expect (hasCitations, insufficient).
    """
    joined = cases.select("id", "expect").join(records, "id", "left")
    cited = F.size(F.coalesce("citations", F.array().cast(records.schema["citations"].dataType)))
    known = F.transform("retrievedSources", lambda c: c["sourceUrl"])
    stray = F.exists("citations", lambda c: ~F.array_contains(known, c["sourceUrl"]))
    ids = F.transform("citations", lambda c: c["documentId"])
    wants, lacks = F.col("expect.hasCitations"), F.col("expect.insufficient")
    checks = F.array(
        F.when(F.col("answer").isNull(), "no answer"),
        F.when(stray, "ungrounded citation"),
        F.when(F.size(ids) > F.size(F.array_distinct(ids)), "duplicate citation"),
        F.when(wants & (cited == 0), "citations expected, none given"),
        F.when(~wants & (cited > 0), "no citations expected, some given"),
        F.when(lacks & ~F.col("insufficient"), "insufficient expected"),
        F.when(~lacks & F.col("insufficient"), "insufficient not expected"),
    )
    failures = F.filter(checks, lambda f: f.isNotNull())
    return joined.select("id", failures.alias("failures")).withColumn(
        "passed", F.size("failures") == 0
    )
