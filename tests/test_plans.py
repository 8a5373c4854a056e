"""A small corpus from raw markup to metrics."""

from pyspark.sql import functions as F

from loomdex import schemas
from loomdex.functions.vectors import hashed_embedder
from loomdex.operators.embedding import embedded_rows
from loomdex.operators.metrics import hit_rates
from loomdex.operators.retrieval import retrieve, searched
from loomdex.plans.ask import prompts, run_results
from loomdex.plans.ingest import ingest_plan


def test_whole_way(spark):
    raw = spark.createDataFrame(
        [("cats", "Cats\n====\n\nCats purr and sleep.\n"), ("dogs", "Dogs\n====\n\nDogs bark loudly.\n")],
        "id string, text string",
    )
    manifest = spark.createDataFrame(
        [(n, n.title(), "src", f"u/{n}", f"{n}.txt", "pets") for n in ("cats", "dogs")], schemas.MANIFEST
    )
    chunks = embedded_rows(ingest_plan(raw, manifest, hashed_embedder()))
    assert [f.name for f in chunks.schema.fields] == [f.name for f in schemas.EMBEDDED_CHUNKS.fields]
    asked = spark.createDataFrame(
        [("Q1", "pets", "do cats purr", "cats purr", "cats", "u/cats", "in_scope"),
         ("Q2", "pets", "who may bark", "dogs bark", "dogs", "u/dogs", "in_scope"),
         ("Q3", "pets", "   ", "", "", "", "in_scope")],
        schemas.QUESTIONS,
    )
    told = {r.id: r.prompt for r in prompts(asked, chunks, hashed_embedder(), "Answer.", 1).collect()}
    assert set(told) == {"Q1", "Q2"}
    assert told["Q1"] == (
        "Answer.\n\n--- Documentation Context ---\n[1] Source: Cats\nCats\n\nCats purr and sleep."
        "\n\n--- Question ---\ndo cats purr"
    )
    answers = asked.select(
        "id", F.lit("Cats purr.").alias("answer"), F.lit(1).alias("retrievalMs"), F.lit(2).alias("generationMs")
    )
    failures = spark.createDataFrame([], "id string, message string, elapsedMs bigint")
    found = retrieve(chunks, asked, hashed_embedder())
    results = run_results(asked.filter("id <> 'Q3'"), found, answers, failures, "nothing")
    rates = hit_rates(results).first()
    assert (rates.n, rates.hit1) == (2, 1.0)


def test_unanswered_and_unembeddable_questions(spark):
    chunks = spark.createDataFrame(
        [("c1", "d1", "T", "s", "u/d1", "c", 0, "cats purr", 800, 100)], schemas.CHUNKS)
    embedder = hashed_embedder()

    def refusing(texts):
        if any("refused" in t for t in texts):
            raise ValueError("no vector for this text")
        return embedder(texts)

    from loomdex.operators.embedding import embed

    asked = spark.createDataFrame(
        [(f"Q{i}", "c", text, "", "d1", "u/d1", "in_scope")
         for i, text in enumerate(["cats", "cats unanswered", "refused", "refused and known"])], schemas.QUESTIONS)
    found, unembedded = searched(embedded_rows(embed(chunks, embedder)), asked, refusing)
    assert {r.queryId for r in found.collect()} == {"Q0", "Q1"}
    answers = spark.createDataFrame(
        [("Q0", "Cats purr.", 1, 2), ("Q1", None, 1, 2)], "id string, answer string, retrievalMs long, generationMs long")
    failures = spark.createDataFrame([("Q3", "429 quota", 7)], "id string, message string, elapsedMs bigint")
    rows = run_results(asked, found, answers, failures, "nothing", unembedded).collect()
    got = {r.id: (r.status, r.generatedAnswer, r.error and r.error.message, r.totalLatencyMs) for r in rows}
    assert got == {
        "Q0": ("success", "Cats purr.", None, 3),
        "Q2": ("error", None, "no vector for this text", None),
        "Q3": ("error", None, "429 quota", 7),
    }
    assert len(rows) == 3
