import pytest
from pyspark.sql import functions as F

from loomdex.operators import answers, runs

FOUND = (
    "queryId string, rank int, chunkId string, documentId string, title string, "
    "sourceUrl string, text string, score double"
)


def found(spark):
    return spark.createDataFrame(
        [
            ("q1", 2, "b-1", "b", "B", "u/b", "text b", 0.8),
            ("q1", 1, "a-1", "a", "A", "u/a", "text a1", 0.9),
            ("q1", 3, "a-2", "a", "A", "u/a", "text a2", 0.7),
            ("q2", 1, "b-1", "b", "B", "u/b", "text b", 0.5),
        ],
        FOUND,
    )


def test_context_and_prompt(spark):
    lists = answers.retrieved_lists(found(spark))
    text = lists.select("queryId", answers.context_text(F.col("retrieved")).alias("c"))
    context = {r.queryId: r.c for r in text.collect()}
    assert context["q1"] == (
        "[1] Source: A\ntext a1\n\n---\n\n[2] Source: B\ntext b\n\n---\n\n[3] Source: A\ntext a2"
    )
    prompt = answers.prompt_text("Do it.", F.lit("CTX"), F.lit("why?"))
    assert lists.select(prompt).first()[0] == (
        "Do it.\n\n--- Documentation Context ---\nCTX\n\n--- Question ---\nwhy?"
    )


def test_citations_best_per_document(spark):
    rows = answers.citations(found(spark)).orderBy("queryId", "place").collect()
    assert [(r.queryId, r.place, r.documentId, r.score) for r in rows] == [
        ("q1", 1, "a", 0.9), ("q1", 2, "b", 0.8), ("q2", 1, "b", 0.5)
    ]
    # an unsorted list: the better, later chunk of a document wins; equal scores keep rank order
    unsorted = spark.createDataFrame(
        [("q", 1, "a-1", "a", "low", "u", "t", 0.1), ("q", 2, "b-1", "b", "B", "u", "t", 0.5),
         ("q", 3, "a-2", "a", "high", "u", "t", 0.5)], FOUND,
    )
    rows = answers.citations(unsorted).orderBy("place").collect()
    assert [(r.documentId, r.title) for r in rows] == [("b", "B"), ("a", "high")]


def records(spark):
    questions = spark.createDataFrame(
        [("q1", "one?"), ("q2", "two?"), ("q3", "nothing found?"), ("q4", "  ")], "id string, question string"
    )
    said = spark.createDataFrame(
        [("q1", "an answer", 5, 10), ("q2", "It DOES NOT provide enough information.", 6, 20),
         ("q3", None, 7, None)],
        "id string, answer string, retrievalMs int, generationMs int",
    )
    return answers.answer_records(questions, found(spark), said, "fixed answer")


def test_answer_records(spark):
    got = {r.id: r for r in records(spark).collect()}
    assert set(got) == {"q1", "q2", "q3"}  # a blank question is not asked
    assert [c.documentId for c in got["q1"].citations] == ["a", "b"]
    assert [s.chunkId for s in got["q1"].retrievedSources] == ["a-1", "b-1", "a-2"]
    assert (got["q1"].insufficient, got["q1"].totalMs) == (False, 15)
    assert (got["q2"].insufficient, got["q2"].citations) == (True, [])
    assert (got["q3"].answer, got["q3"].insufficient, got["q3"].citations) == ("fixed answer", True, [])
    assert (got["q3"].generationMs, got["q3"].totalMs) == (0, 7)
    assert len(answers.public_response(records(spark)).columns) == 6


def test_citation_checks(spark):
    rows = spark.sql("""
      SELECT 'r' AS id, 'text' AS answer, false AS insufficient,
        array(named_struct('sourceUrl', 'u1', 'documentId', 'd1')) AS retrievedSources,
        array(named_struct('sourceUrl', 'u1', 'documentId', 'd1'),
              named_struct('sourceUrl', 'u9', 'documentId', 'd9'),
              named_struct('sourceUrl', 'u1', 'documentId', 'd1')) AS citations
      UNION ALL SELECT 's', 'text', true,
        array(named_struct('sourceUrl', 'u1', 'documentId', 'd1')),
        filter(array(named_struct('sourceUrl', 'u1', 'documentId', 'd1')), x -> false)
    """)
    assert [tuple(r) for r in answers.ungrounded_citations(rows).collect()] == [("r", "u9")]
    assert [tuple(r) for r in answers.repeated_citations(rows).collect()] == [("r", "d1")]
    cases = spark.sql("""
      SELECT id, named_struct('hasCitations', h, 'insufficient', i) AS expect
      FROM VALUES ('r', false, true), ('s', false, true), ('t', true, false) AS v(id, h, i)
    """)
    got = {r.id: r for r in answers.case_failures(rows, cases).collect()}
    assert got["r"].failures == [
        "ungrounded citation", "duplicate citation", "no citations expected, some given",
        "insufficient expected",
    ]
    assert got["s"].passed and not got["t"].passed
    assert got["t"].failures[0] == "no answer"


def test_answer_lines(spark):
    rows = spark.createDataFrame([("a", "one\n\n  \ntwo ")], "id string, answer string")
    assert [tuple(r) for r in answers.answer_lines(rows).collect()] == [("a", 1, "one"), ("a", 2, "two ")]


@pytest.mark.parametrize(
    "message, code, quota, transient",
    [
        ('{"error":{"code":429,"message":"x"}}', 429, True, True),
        ('{"code":503}', 503, False, True),
        ("You exceeded your Quota", None, True, False),
        ("boom", None, False, False),
        (None, None, False, False),
    ],
)
def test_errors(spark, message, code, quota, transient):
    rows = spark.createDataFrame([("a", message)], "id string, message string")
    got = runs.classified_errors(rows).first()
    assert (got.code, got.quota, got.transient) == (code, quota, transient)


def test_long_messages_are_cut(spark):
    rows = spark.createDataFrame([("a", "x" * 500)], "id string, message string")
    assert len(runs.classified_errors(rows).first().message) == 200


def questions(spark):
    return spark.createDataFrame([(f"Q{i}", i) for i in range(1, 7)], "id string, position int")


def earlier(spark):
    return spark.createDataFrame(
        [("Q1", "success", 1, "old"), ("Q1", "success", 3, "new"), ("Q1", "error", 4, "late error"),
         ("Q2", "error", 2, "e"), ("Q4", "success", 5, "x")],
        "id string, status string, attempt int, answer string",
    )


def test_resume(spark):
    todo = runs.next_questions(questions(spark), earlier(spark))
    assert sorted(r.id for r in todo.collect()) == ["Q2", "Q3", "Q5", "Q6"]
    todo = runs.next_questions(questions(spark), earlier(spark), start="q3", limit=2)
    assert [r.id for r in todo.orderBy("position").collect()] == ["Q3", "Q5"]
    with pytest.raises(ValueError):
        runs.questions_from(questions(spark), "Q99")


def test_merge_and_summary(spark):
    fresh = spark.createDataFrame(
        [("Q3", "success", 9, "n"), ("Q2", "error", 9, "again")],
        "id string, status string, attempt int, answer string",
    )
    merged = runs.merged_results(questions(spark), earlier(spark), fresh, "attempt")
    got = [(r.id, r.answer) for r in merged.orderBy("is_new", "position").collect()]
    assert got == [("Q1", "new"), ("Q4", "x"), ("Q2", "again"), ("Q3", "n")]
    summary = runs.run_summary(questions(spark), earlier(spark), fresh).first()
    assert summary.asDict() == {
        "total": 6, "previously_done": 2, "run_success": 1, "run_errors": 1, "completed": 4,
        "remaining": 2,
    }


def test_evaluation_results(spark):
    asked = spark.createDataFrame(
        [(q, "c", "in_scope", q, "t", "a", "u") for q in ("q1", "q2", "q3")],
        "id string, category string, scope string, question string, groundTruth string, "
        "expectedSource string, expectedSourceUrl string",
    )
    failed = spark.createDataFrame(
        [("q2", '{"code":503,"message":"busy"}', 44)], "id string, message string, elapsedMs int"
    )
    got = {r.id: r for r in runs.evaluation_results(asked, records(spark), failed).collect()}
    assert (got["q1"].status, got["q1"].totalLatencyMs, got["q1"].error) == ("success", 15, None)
    assert (got["q2"].status, got["q2"].totalLatencyMs, got["q2"].retrievedSources) == ("error", 44, [])
    assert (got["q2"].generatedAnswer, got["q2"].insufficient, got["q2"].error.code) == (None, None, 503)


def test_long_error_codes_are_kept(spark):
    from loomdex.operators.runs import error_code

    rows = spark.createDataFrame([('{"code":12345678901}',), ("no code",)], "message string")
    assert [r[0] for r in rows.select(error_code(F.col("message"))).collect()] == [12345678901, None]
