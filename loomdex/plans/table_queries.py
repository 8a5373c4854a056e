"""One query per operator, run over the driver's whole tables.

Vectors and scores are rounded to six decimals in the output, lists are given
as rows, so that results can be compared with another engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.markup import collapse_space, first_line_title, strip_inline_markup
from loomdex.functions.text import keywords
from loomdex.operators import answers, bands, chunks, corpus, embedding, experiments
from loomdex.operators import metrics, retrieval, runs, store, validation
from loomdex.plans import given_tables as given
from loomdex.session import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PAIR = ("chunk-300", "chunk-800")


def query(function: Query) -> Query:
    QUERIES[function.__name__.rstrip("_")] = function
    return function


def r6(column: str):
    return F.round(F.col(column), 6).alias(column)


# --- corpus ------------------------------------------------------------------
def _corpus(spark, folder):
    return given.table(spark, folder, "documents").select(given.document_id("doc_id").alias("id"), "text")


def _manifest(spark, folder):
    chosen = corpus.selected_documents(given.selection(spark, folder), _corpus(spark, folder))
    return corpus.corpus_manifest(chosen, "corpus")


@query
def corpus_missing(spark, folder):
    missing = corpus.missing_documents(given.selection(spark, folder), _corpus(spark, folder))
    return missing.select("id", "title")


@query
def corpus_selected(spark, folder):
    chosen = corpus.selected_documents(given.selection(spark, folder), _corpus(spark, folder))
    return chosen.select("id", "title", F.length("text").alias("chars"))


@query
def corpus_short(spark, folder):
    return _corpus(spark, folder).select("id", corpus.short_source(F.col("text")).alias("short"))


@query
def corpus_manifest(spark, folder):
    return _manifest(spark, folder)


@query
def corpus_manifest_saved(spark, folder):
    return corpus.saved_manifest(_manifest(spark, folder))


@query
def corpus_report(spark, folder):
    return corpus.corpus_report(given.selection(spark, folder), _manifest(spark, folder))


def _cleaned(spark, folder):
    return corpus.clean_corpus(given.marked_up(spark, folder), given.manifest(spark, folder))


@query
def clean_corpus(spark, folder):
    return corpus.parsed_documents(_cleaned(spark, folder))


@query
def parse_rejects(spark, folder):
    return corpus.parse_rejects(_cleaned(spark, folder))


@query
def parse_report(spark, folder):
    return corpus.parse_report(_cleaned(spark, folder))


@query
def clean_effect(spark, folder):
    return corpus.cleaning_effect(_cleaned(spark, folder))


@query
def extract_title(spark, folder):
    docs = given.documents(spark, folder)
    return docs.select(
        "documentId", first_line_title(F.col("text"), F.col("title")).alias("extractedTitle")
    )


@query
def clean_collapse(spark, folder):
    spaced = F.concat(F.lit("\n \n\n"), F.replace(F.col("text"), F.lit(" "), F.lit("\n    \n\n")))
    return given.documents(spark, folder).select(
        "documentId", collapse_space(spaced).alias("text")
    )


@query
def strip_roles(spark, folder):
    marked = F.concat(
        F.lit(":ref:`"), "category", F.lit(" page <"), "source", F.lit(">` :doc:`"), "documentId",
        F.lit("` ``"), "source", F.lit("`` |"), "category", F.lit("| {+a b+} "), "text",
    )
    return given.documents(spark, folder).select(
        "documentId", strip_inline_markup(marked).alias("text")
    )


# --- chunks --------------------------------------------------------------------
@query
def chunk_800(spark, folder):
    return given.chunks(spark, folder, "chunk-800").select("documentId", "chunkIndex", "text")


@query
def chunk_300(spark, folder):
    return given.chunks(spark, folder, "chunk-300").select("documentId", "chunkIndex", "text")


@query
def chunk_rows(spark, folder):
    return given.chunks(spark, folder)


@query
def chunk_doc_stats(spark, folder):
    return chunks.chunk_document_stats(given.documents(spark, folder), given.chunks(spark, folder))


@query
def chunk_report(spark, folder):
    return chunks.chunk_report(given.documents(spark, folder), given.chunks(spark, folder), 800)


@query
def chunk_overlap_check(spark, folder):
    return chunks.overlap_check(given.chunks(spark, folder))


@query
def chunk_first_rows(spark, folder):
    return store.first_rows(given.chunks(spark, folder), 200).select("chunkId")


# --- embedding and vector tables -----------------------------------------------------
@query
def embed_hashed(spark, folder):
    return embedding.hashed_terms(given.chunks(spark, folder))


@query
def embed_batches(spark, folder):
    held = embedding.batch_members(given.chunks(spark, folder))
    return held.withColumn("chunkIds", F.array_join("chunkIds", ","))


@query
def embed_rejects(spark, folder):
    return embedding.rejected_texts(given.vector_records(spark, folder))


@query
def embed_failures(spark, folder):
    """Dead letters of an embedder that refuses texts without any a-z letter or over 5,000 characters."""
    hashed = given.hashed_embedder()

    def strict(texts):
        matrix = hashed(texts)
        if any(len(t) > 5000 for t in texts) or not matrix.any(axis=1).all():
            raise ValueError("text refused")
        return matrix

    rows = given.vector_records(spark, folder).filter(F.col("chunkId").isNotNull())
    return embedding.failed_rows(embedding.embed(rows.select("chunkId", "text"), strict))


@query
def embed_todo(spark, folder):
    docs = given.documents(spark, folder).withColumnRenamed("documentId", "chunkId")
    done = given.vector_records(spark, folder)
    return embedding.embed_todo(docs, done).select("chunkId")


@query
def dim_check(spark, folder):
    return validation.dimension_check(given.vector_records(spark, folder))


@query
def dim_counts(spark, folder):
    return validation.dimensions(given.vector_records(spark, folder))


@query
def dup_ids(spark, folder):
    known = given.vector_records(spark, folder).filter(F.col("chunkId").isNotNull())
    return validation.duplicate_ids(known)


@query
def dup_groups(spark, folder):
    known = given.vector_records(spark, folder).filter(F.col("chunkId").isNotNull())
    return validation.duplicate_groups(known)


@query
def validate_input(spark, folder):
    return validation.input_errors(given.vector_records(spark, folder))


@query
def store_check(spark, folder):
    known = given.vector_records(spark, folder).filter(F.col("chunkId").isNotNull())
    return validation.store_check(known)


@query
def store_verdict(spark, folder):
    vectors = given.table(spark, folder, "embeddings")
    return validation.store_verdict(vectors, dimension=64, key="vec_id")


@query
def store_sample(spark, folder):
    sample = validation.sample_record(given.table(spark, folder, "embeddings"), key="vec_id")
    return sample.select(
        "vec_id", "label", "dimension",
        F.round(F.get(F.col("first_values"), F.lit(0)).cast("double"), 6).alias("first_value"),
    )


@query
def chunk_file_check(spark, folder):
    return validation.chunk_table_check(given.chunks(spark, folder), 800, 100)


@query
def vector_file_check(spark, folder):
    known = given.vector_records(spark, folder).filter(F.col("chunkId").isNotNull())
    return validation.vector_table_check(known)


@query
def vector_complete(spark, folder):
    """Vector records against the number of documents they should be for."""
    expected = given.table(spark, folder, "documents").count()
    known = given.vector_records(spark, folder).filter(F.col("chunkId").isNotNull())
    return validation.vector_table_check(known, expected)


# --- store ----------------------------------------------------------------------------
def _rechunked(spark, folder):
    """Documents labelled good, chunked anew with the small configuration."""
    good = given.table(spark, folder, "labels").filter(F.col("quality") == 1)
    docs = given.documents(spark, folder).join(
        good.select(given.document_id("doc_id").alias("documentId")), "documentId", "left_semi"
    )
    return chunks.chunk_documents(docs, *given.EXPERIMENTS["chunk-300"])


@query
def upsert_chunks(spark, folder):
    return store.upserted(given.chunks(spark, folder), _rechunked(spark, folder)).select(
        "chunkId", "chunkIndex", "text", "chunkSize", "overlap"
    )


@query
def upsert_counts(spark, folder):
    return store.upsert_counts(given.chunks(spark, folder), _rechunked(spark, folder))


@query
def experiment_swap(spark, folder):
    """Documents' chunks of both configurations; the small one is loaded anew for good documents."""
    sizes = {name: given.chunks(spark, folder, name).select(
        "chunkId", "text", F.lit(name).alias("experiment")) for name in PAIR}
    stored = sizes["chunk-300"].unionByName(sizes["chunk-800"])
    return store.swap_counts(stored, _rechunked(spark, folder), "chunk-300")


# --- retrieval ---------------------------------------------------------------------------
@query
def topk_cosine(spark, folder):
    vectors = given.table(spark, folder, "embeddings")
    found = retrieval.nearest(
        vectors, given.label_centroids(spark, folder), 5, chunk_id="vec_id", query_id="label",
        query_vector="centroid",
    )
    return found.select("label", "rank", "vec_id", r6("cosine"), r6("score"))


@query
def topk_lsh(spark, folder):
    vectors = given.table(spark, folder, "embeddings")
    # Keys are made once and stored with the vectors, as in use.
    stored = written(bands.with_band_keys(vectors.drop("label"), 64))
    asked = written(bands.with_band_keys(given.label_centroids(spark, folder), 64, vector="centroid"))
    found = bands.nearest_in_bands(
        stored, asked, 5, chunk_id="vec_id", query_id="label", query_vector="centroid")
    return found.select("label", "rank", "vec_id", r6("cosine"), r6("score"))


@query
def retrieve_all(spark, folder):
    return given.retrieved(spark, folder).select(
        "queryId", "rank", "chunkId", "documentId", "title", "source", "sourceUrl", "category",
        "chunkIndex", "text", r6("cosine"), r6("score"),
    )


@query
def retrieve_300(spark, folder):
    return given.retrieved(spark, folder, "chunk-300").select(
        "queryId", "rank", "chunkId", "documentId", r6("score")
    )


@query
def question_filter(spark, folder):
    """User turns of the conversations, and those among them that ask nothing."""
    turns = given.table(spark, folder, "conversations").select(
        "conv_id", "turn",
        F.when(F.col("role") == "user", F.col("text")).otherwise(" \n ").alias("question"),
    )
    asked = retrieval.valid_questions(turns).withColumn("kept", F.lit(True))
    rest = retrieval.rejected_questions(turns).withColumn("kept", F.lit(False))
    return asked.unionByName(rest)


# --- contexts, citations, answers -----------------------------------------------------------
def _question_lists(spark, folder):
    lists = answers.retrieved_lists(given.retrieved(spark, folder))
    asked = given.table(spark, folder, "benchmark").select(
        F.concat(F.lit("Q"), "item_id").alias("queryId"), F.col("text").alias("question")
    )
    return lists.join(asked, "queryId")


@query
def build_context(spark, folder):
    return _question_lists(spark, folder).select(
        F.col("queryId").alias("id"), answers.context_text(F.col("retrieved")).alias("context")
    )


@query
def build_prompt(spark, folder):
    context = answers.context_text(F.col("retrieved"))
    return _question_lists(spark, folder).select(
        F.col("queryId").alias("id"),
        answers.prompt_text("Answer from the excerpts.", context, F.col("question")).alias("prompt"),
    )


@query
def citations(spark, folder):
    found = answers.citations(given.retrieved(spark, folder))
    return found.select("queryId", "place", "title", "sourceUrl", "documentId", r6("score"))


@query
def insufficient(spark, folder):
    turns = given.table(spark, folder, "conversations")
    answer = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" " + given.NO_CONTEXT_ANSWER.upper())))
    return turns.select(
        "conv_id", "turn",
        answers.is_insufficient(F.coalesce(answer, "text")).alias("insufficient"),
    )


def _flat(records: DataFrame) -> DataFrame:
    cited = F.array_join(F.transform("citations", lambda c: c["documentId"]), ",")
    return records.select(
        "id", "question", "answer", "insufficient", cited.alias("cited"),
        F.array_join(F.transform("retrievedSources", lambda c: c["chunkId"]), ",").alias("retrieved"),
        "retrievalMs", "generationMs", "totalMs",
    )


@query
def answer_records(spark, folder):
    return _flat(given.records(spark, folder))


@query
def public_response(spark, folder):
    shown = answers.public_response(given.records(spark, folder))
    cited = F.array_join(F.transform("citations", lambda c: c["sourceUrl"]), ",")
    return shown.withColumn("citations", cited)


@query
def answer_lines(spark, folder):
    turns = given.table(spark, folder, "conversations").filter(F.col("role") == "assistant")
    return answers.answer_lines(
        turns.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text"), answer="text"
    )


def _tampered(spark, folder):
    """Answer records with an invented citation added where the answer is long,
    and the first citation repeated where it is short."""
    rows = given.records(spark, folder)
    fake = F.transform(F.slice("citations", 1, 1), lambda c: F.struct(
        c["title"].alias("title"), F.concat(c["sourceUrl"], F.lit("/gone")).alias("sourceUrl"),
        c["documentId"].alias("documentId"), c["score"].alias("score"),
    ))
    added = F.when(F.length("answer") > 700, fake).otherwise(F.slice("citations", 1, 1))
    return rows.withColumn("citations", F.concat("citations", added))


@query
def citation_grounding(spark, folder):
    return answers.ungrounded_citations(_tampered(spark, folder))


@query
def citation_dups(spark, folder):
    return answers.repeated_citations(_tampered(spark, folder))


@query
def case_check(spark, folder):
    cases = given.questions(spark, folder).select("id", F.struct(
        (F.col("scope") == "in_scope").alias("hasCitations"),
        (F.col("scope") == "out_of_scope").alias("insufficient"),
    ).alias("expect"))
    checked = answers.case_failures(given.records(spark, folder), cases)
    return checked.select("id", F.array_join("failures", "; ").alias("failures"), "passed")


# --- runs --------------------------------------------------------------------------------
@query
def resume_todo(spark, folder):
    return runs.remaining_questions(
        given.customer_questions(spark, folder), given.previous_runs(spark, folder)
    )


@query
def resume_start(spark, folder):
    return runs.next_questions(
        given.customer_questions(spark, folder), given.previous_runs(spark, folder),
        start="q50", limit=40,
    )


def _new_rows(spark, folder):
    todo = runs.remaining_questions(
        given.customer_questions(spark, folder), given.previous_runs(spark, folder)
    )
    return given.new_runs(spark, folder).join(todo.select("id"), "id", "left_semi")


@query
def completed_results(spark, folder):
    return runs.completed_results(given.previous_runs(spark, folder), "attempt")


@query
def merge_results(spark, folder):
    return runs.merged_results(
        given.customer_questions(spark, folder), given.previous_runs(spark, folder),
        _new_rows(spark, folder), "attempt",
    )


@query
def error_code(spark, folder):
    log = given.run_log(spark, folder)
    text = F.coalesce("message", F.lit("no code"))
    return log.select(
        "event_id", runs.error_code(text).alias("code"), runs.short_message(text).alias("message")
    )


@query
def error_class(spark, folder):
    log = given.run_log(spark, folder)
    return runs.classified_errors(log.filter(F.col("message").isNotNull()), "event_id").select(
        "event_id", "code", "quota", "transient"
    )


@query
def run_summary(spark, folder):
    return runs.run_summary(
        given.customer_questions(spark, folder), given.previous_runs(spark, folder),
        _new_rows(spark, folder),
    )


@query
def evaluation_results(spark, folder):
    rows = given.results(spark, folder)
    return rows.select(
        "id", "category", "scope", "expectedSource", "expectedSourceUrl", "generatedAnswer",
        "insufficient", "retrievalLatencyMs", "generationLatencyMs", "totalLatencyMs", "status",
        F.array_join(F.transform("retrievedSources", lambda c: c["chunkId"]), ",").alias("retrieved"),
        F.array_join(F.transform("citations", lambda c: c["documentId"]), ",").alias("cited"),
        F.col("error.code").alias("error_code"), F.col("error.message").alias("error_message"),
    )


# --- metrics -----------------------------------------------------------------------------------
@query
def metrics_overview(spark, folder):
    return metrics.overview(given.table(spark, folder, "benchmark"), given.results(spark, folder))


@query
def hit_at_k(spark, folder):
    return metrics.hit_rates(given.results(spark, folder))


@query
def hit_flags(spark, folder):
    return metrics.hit_flags(given.results(spark, folder)).select("id", "hit1", "hit3", "hit5")


@query
def citation_precision(spark, folder):
    return metrics.citation_precision(given.results(spark, folder))


@query
def citation_coverage(spark, folder):
    return metrics.citation_coverage(given.results(spark, folder))


@query
def oos_rate(spark, folder):
    return metrics.out_of_scope_rate(given.results(spark, folder))


@query
def keywords_(spark, folder):
    return given.documents(spark, folder).select(
        "documentId", F.array_join(F.array_sort(keywords(F.col("text"))), " ").alias("keywords")
    )


@query
def answer_score(spark, folder):
    """Every assistant turn scored against the user turn before it.

    Turns are paired on the unique (conversation, turn), not by a window.
    """
    turns = given.table(spark, folder, "conversations")
    asked = turns.filter(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("groundTruth")
    )
    said = turns.filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("generatedAnswer")
    )
    return metrics.answer_score(asked.join(said, ["conv_id", "turn"])).select(
        "conv_id", "turn", "hits", "total", "score", "label"
    )


@query
def answer_labels(spark, folder):
    return metrics.answer_labels(given.results(spark, folder)).select(
        "id", "label", "score", "hits", "total"
    )


@query
def answer_quality(spark, folder):
    return metrics.answer_quality(given.results(spark, folder))


@query
def latency_stats(spark, folder):
    return metrics.latency_stats(given.results(spark, folder))


@query
def latency_events(spark, folder):
    return metrics.value_stats(given.run_log(spark, folder), "event_type", "ms")


@query
def per_category(spark, folder):
    return metrics.per_category(given.results(spark, folder))


@query
def metrics_long(spark, folder):
    return metrics.metrics_long(given.table(spark, folder, "benchmark"), given.results(spark, folder))


# --- experiments -----------------------------------------------------------------------------------
@query
def retrieval_eval(spark, folder):
    return experiments.retrieval_evaluation(given.experiment_rows(spark, folder))


@query
def misses(spark, folder):
    return experiments.misses(given.experiment_rows(spark, folder))


@query
def exp_compare(spark, folder):
    evaluated = experiments.retrieval_evaluation(given.experiment_rows(spark, folder))
    return experiments.compare_metrics(evaluated, PAIR)


@query
def exp_by_category(spark, folder):
    return experiments.compare_categories(given.experiment_rows(spark, folder), PAIR)


@query
def exp_flips(spark, folder):
    return experiments.flips(given.experiment_rows(spark, folder), PAIR)


@query
def score_margin(spark, folder):
    rows = experiments.score_margins(given.experiment_rows(spark, folder))
    return rows.select(
        "experiment", "id", "expectedSource", "top_document", r6("top_score"), "expected_rank",
        r6("expected_score"), r6("margin"),
    )


@query
def failure_class(spark, folder):
    return experiments.failure_class(given.experiment_rows(spark, folder))


@query
def topk_dominance(spark, folder):
    return experiments.top_k_dominance(given.experiment_rows(spark, folder))


@query
def source_integrity(spark, folder):
    docs = given.documents(spark, folder).join(
        given.table(spark, folder, "labels").select(given.document_id("doc_id").alias("documentId")),
        "documentId", "left_semi",
    )
    return experiments.unknown_sources(given.questions(spark, folder), docs)


@query
def question_dist(spark, folder):
    return experiments.question_distribution(given.questions(spark, folder))
