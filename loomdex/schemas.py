"""Explicit schemas of every table; nothing is ever inferred from files."""

from pyspark.sql import types as T

_S, _I, _L, _D, _B = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(),
)


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


VECTOR = T.ArrayType(T.FloatType(), containsNull=False)

MANIFEST = _table(
    ("id", _S), ("title", _S), ("source", _S), ("sourceUrl", _S), ("file", _S), ("category", _S),
)
DOCUMENTS = _table(
    ("documentId", _S), ("title", _S), ("extractedTitle", _S), ("source", _S),
    ("sourceUrl", _S), ("category", _S), ("originalFile", _S), ("text", _S),
)
REJECTS = _table(("file", _S), ("reason", _S))
CHUNKS = _table(
    ("chunkId", _S), ("documentId", _S), ("title", _S), ("source", _S), ("sourceUrl", _S),
    ("category", _S), ("chunkIndex", _I), ("text", _S), ("chunkSize", _I), ("overlap", _I),
)
EMBEDDED_CHUNKS = T.StructType(CHUNKS.fields + [T.StructField("embedding", VECTOR)])
EMBED_FAILURES = _table(("chunkId", _S), ("error", _S))
QUESTIONS = _table(
    ("id", _S), ("category", _S), ("question", _S), ("groundTruth", _S),
    ("expectedSource", _S), ("expectedSourceUrl", _S), ("scope", _S),
)
RETRIEVED_SOURCE = _table(
    ("chunkId", _S), ("documentId", _S), ("title", _S), ("sourceUrl", _S), ("score", _D),
)
CITATION = _table(("title", _S), ("sourceUrl", _S), ("documentId", _S), ("score", _D))
RUN_ERROR = _table(("code", _L), ("message", _S))
RESULTS = T.StructType(
    QUESTIONS.fields
    + _table(
        ("generatedAnswer", _S),
        ("insufficient", _B),
        ("retrievedSources", T.ArrayType(RETRIEVED_SOURCE)),
        ("citations", T.ArrayType(CITATION)),
        ("retrievalLatencyMs", _L),
        ("generationLatencyMs", _L),
        ("totalLatencyMs", _L),
        ("status", _S),
        ("error", RUN_ERROR),
    ).fields
)
RETRIEVAL_RESULTS = _table(
    ("id", _S), ("category", _S), ("question", _S), ("expectedSource", _S),
    ("retrievedSources", T.ArrayType(RETRIEVED_SOURCE)),
    ("hit1", _B), ("hit3", _B), ("hit5", _B), ("latencyMs", _L), ("error", _S),
)
EXPERIMENT = _table(
    ("id", _S), ("label", _S), ("chunkSize", _I), ("overlap", _I),
    ("chunksFile", _S), ("embeddingsFile", _S), ("resultsDir", _S),
)
EXPERIMENT_CONFIG = _table(
    ("description", _S),
    ("experiments", T.ArrayType(EXPERIMENT)),
    ("sharedConfig", _table(
        ("embeddingModel", _S), ("generationModel", _S), ("topK", _I),
        ("evaluationQuestions", _S), ("note", _S),
    )),
)
CITATION_CASES = _table(
    ("id", _S), ("question", _S),
    ("expect", _table(("hasCitations", _B), ("insufficient", _B))),
)
