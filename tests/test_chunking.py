import pytest
from pyspark.sql import functions as F

from loomdex.functions.chunking import chunk_texts
from loomdex.operators.chunks import (
    chunk_document_stats,
    chunk_documents,
    chunk_report,
    overlap_check,
)

DOCUMENT = "documentId string, title string, source string, sourceUrl string, category string, text string"


def documents(spark, *texts):
    return spark.createDataFrame(
        [(f"d{i}", "t", "s", "u", "c", text) for i, text in enumerate(texts)], DOCUMENT
    )


@pytest.mark.parametrize(
    "text, size, overlap, expected",
    [
        ("", 10, 3, []),
        ("0123456789", 10, 3, ["0123456789"]),
        # a long line is cut, then its tail starts the next chunk
        ("0123456789a", 10, 3, ["0123456789", "a", "89a"]),
        ("0123456789" * 2 + "abcde", 10, 3, ["0123456789", "0123456789", "abcde", "cde"]),
        ("0123456789a\nxy", 10, 3, ["0123456789", "a", "89a\nxy"]),
        ("ab\n0123456789a", 10, 3, ["ab", "0123456789", "a", "89a"]),
        # a blank piece of a long line is kept, its blank tail is not
        (" " * 12, 10, 3, ["", ""]),
        # the tail starts after a line break inside it, but not at its ends
        ("aaaaaa\nbb\ncccc", 10, 4, ["aaaaaa\nbb", "bb\ncccc"]),
        ("aaaaaaaaa\ncccccc", 10, 4, ["aaaaaaaaa", "aaaa\ncccccc"]),
        ("aaaaa\nbbbbb", 10, 0, ["aaaaa", "bbbbb"]),
        # the tail "a", break, break is cut after its first break, and a blank rest is trimmed
        ("aaaaa\n\n\nbbbb", 10, 3, ["aaaaa", "bbbb"]),
        ("a\nb\nc", 10, 3, ["a\nb\nc"]),
        (" ab　", 10, 3, ["ab"]),
    ],
)
def test_rules(spark, text, size, overlap, expected):
    frame = spark.createDataFrame([(text,)], "text string")
    assert frame.select(chunk_texts(F.col("text"), size, overlap)).first()[0] == expected


@pytest.mark.parametrize("size, overlap", [(0, 0), (-1, 0), (10, -1), (10, 10), (10.5, 1), (True, 0)])
def test_bad_settings_are_rejected(size, overlap):
    with pytest.raises(ValueError):
        chunk_texts(None, size, overlap)


def test_very_long_documents_are_whole(spark):
    """100,000 lines and one line of 2,000,000 characters, nothing lost."""
    lines = "\n".join(f"line {i:06d}" for i in range(100_000))
    long_line = "".join(chr(97 + i % 26) for i in range(2_000_000))
    found = chunk_documents(documents(spark, lines, long_line), 800, 0)
    rows = found.groupBy("documentId").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"),
        F.max("chunkIndex").alias("last"), F.count_distinct("chunkId").alias("ids"),
    ).orderBy("documentId").collect()
    per_chunk = 800 // 12  # eleven characters and a line break
    assert rows[0]["n"] == -(-100_000 // per_chunk)
    assert rows[0]["chars"] == len(lines) - (rows[0]["n"] - 1)
    assert (rows[1]["n"], rows[1]["chars"]) == (2500, 2_000_000)
    assert all(r["last"] == r["n"] - 1 and r["ids"] == r["n"] for r in rows)


def test_chunk_rows(spark):
    rows = chunk_documents(documents(spark, "aaaa\nbbbb", " \n ", "cc"), 5, 1).orderBy("chunkId").collect()
    assert [(r.chunkId, r.chunkIndex, r.text, r.chunkSize, r.overlap) for r in rows] == [
        ("d0-0000", 0, "aaaa", 5, 1), ("d0-0001", 1, "a\nbbbb", 5, 1), ("d2-0000", 0, "cc", 5, 1),
    ]


def test_index_grows_beyond_four_digits(spark):
    found = chunk_documents(documents(spark, "\n".join(["x"] * 10_002)), 1, 0)
    last = found.orderBy(F.desc("chunkIndex")).first()
    assert last.chunkId == "d0-10001"


def test_reports(spark):
    docs = documents(spark, "aaaa\nbbbb", "cc")
    found = chunk_documents(docs, 5, 1)
    stats = {r.documentId: r for r in chunk_document_stats(docs, found).collect()}
    assert (stats["d0"].num_chunks, stats["d0"].min_len, stats["d0"].avg_len) == (2, 4, 5)
    report = chunk_report(docs, found, 5).first()
    assert (report.documents, report.chunks, report.chunks_per_document) == (2, 3, 1.5)
    assert (report.min_chunk, report.max_chunk) == ("d1-0000", "d0-0001")
    assert [r.overlap_found for r in overlap_check(found).collect()] == [True]
