import json

import pytest

from loomdex import schemas
from loomdex.functions.vectors import hashed_embedder
from loomdex.operators.experiments import select_experiment
from loomdex.operators.store import read_store
from loomdex.plans.ingest import write_ingest
from loomdex.sources import files
from loomdex.streaming.ingest import start_ingest

MANIFEST = [
    {"id": name, "title": name.upper(), "source": "docs", "sourceUrl": f"u/{name}",
     "file": f"data/raw/{name}.txt", "category": "c"}
    for name in ("one", "two", "three")
]
CONFIG = {
    "description": "x",
    "experiments": [
        {"id": "chunk-300", "label": "small", "chunkSize": 300, "overlap": 50, "chunksFile": "a",
         "embeddingsFile": "b", "resultsDir": "c"},
        {"id": "chunk-800", "label": "large", "chunkSize": 800, "overlap": 100, "chunksFile": "a",
         "embeddingsFile": "b", "resultsDir": "c"},
    ],
    "sharedConfig": {"embeddingModel": "m", "generationModel": "g", "topK": 5,
                     "evaluationQuestions": "q", "note": "n"},
}


def test_reads(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "one.txt").write_text("line 1\nline 2\n")
    (tmp_path / "raw" / "skip.md").write_text("no")
    (tmp_path / "manifest.json").write_text(json.dumps(MANIFEST, indent=2))
    (tmp_path / "config.json").write_text(json.dumps(CONFIG, indent=2))
    raw = files.read_raw_corpus(spark, str(tmp_path / "raw")).collect()
    assert [tuple(r) for r in raw] == [("one", "line 1\nline 2\n")]
    manifest = files.read_manifest(spark, str(tmp_path / "manifest.json"))
    assert manifest.count() == 3 and manifest.schema == schemas.MANIFEST
    config = files.read_experiment_config(spark, str(tmp_path / "config.json"))
    chosen = select_experiment(config, "chunk-300").first()
    assert (chosen.chunkSize, chosen.overlap, chosen.topK) == (300, 50, 5)
    with pytest.raises(ValueError, match="chunk-300"):
        select_experiment(config, "chunk-500")
    files.write_json_table(manifest, str(tmp_path / "out"))
    assert spark.read.schema(schemas.MANIFEST).json(str(tmp_path / "out")).count() == 3


def test_incremental_ingest(spark, tmp_path):
    raw, table = tmp_path / "raw", str(tmp_path / "table")
    raw.mkdir()
    manifest = spark.createDataFrame([tuple(m.values()) for m in MANIFEST], schemas.MANIFEST)

    def run():
        query = start_ingest(
            spark, str(raw), manifest, table, str(tmp_path / "staging"), str(tmp_path / "cp"),
            hashed_embedder(), "chunk-800",
        )
        query.awaitTermination(120)
        assert query.exception() is None

    (raw / "one.txt").write_text("Title\n=====\n\nfirst text\n")
    (raw / "unknown.txt").write_text("not in the manifest\n")
    run()
    (raw / "two.txt").write_text("second text\n")
    run()
    run()  # nothing new
    stored = read_store(spark, table, schemas.EMBEDDED_CHUNKS)
    got = {r.chunkId: (r.text, r.experiment, len(r.embedding)) for r in stored.collect()}
    assert got == {
        "one-0000": ("Title\n\nfirst text", "chunk-800", 1024),
        "two-0000": ("second text", "chunk-800", 1024),
    }
    rejects = spark.read.parquet(f"{table}_rejects").select("file", "reason").collect()
    assert [tuple(r) for r in rejects] == [("unknown.txt", "no manifest entry")]


def test_stream_knows_what_it_has(spark, tmp_path):
    from collections import Counter

    table, asked = str(tmp_path / "table"), Counter()
    manifest = spark.createDataFrame([tuple(m.values()) for m in MANIFEST], schemas.MANIFEST)
    log = tmp_path / "asked"
    log.mkdir()
    log_folder, inner = str(log), hashed_embedder()

    def embedder(texts):
        import os
        import uuid
        if any("refused" in t for t in texts):
            raise ValueError("refused")
        with open(os.path.join(log_folder, uuid.uuid4().hex), "w") as out:
            out.write("\n".join(t.split()[0] for t in texts))
        return inner(texts)

    def run(folder, **texts):
        asked.clear()
        seen = set(log.iterdir())
        (tmp_path / "raw" / folder).mkdir(parents=True)
        for name, text in texts.items():
            (tmp_path / "raw" / folder / f"{name}.txt").write_text(text)
        query = start_ingest(
            spark, f"{tmp_path}/raw/*", manifest, table, str(tmp_path / "staging"), str(tmp_path / "cp"),
            embedder, "chunk-300", 300, 50)
        query.awaitTermination(240)
        assert query.exception() is None
        for file in set(log.iterdir()) - seen:
            asked.update(file.read_text().split("\n"))
        stored = read_store(spark, table, schemas.EMBEDDED_CHUNKS)
        return Counter(r.documentId for r in stored.collect()), set(asked)

    long = "\n".join(f"one line number {i} of a text with several chunks" for i in range(30))
    held, _ = run("a", one=long, two="two as it was", three="three as it was")
    assert held["one"] > 3 and held["two"] == held["three"] == 1
    # unchanged, changed, shortened
    held, embedded = run("b", one="one shortened", two="two as it was", three="three changed")
    assert held == {"one": 1, "two": 1, "three": 1} and embedded == {"one", "three"}
    texts = {r.documentId: r.text for r in read_store(spark, table, schemas.EMBEDDED_CHUNKS).collect()}
    assert texts == {"one": "one shortened", "two": "two as it was", "three": "three changed"}
    # a text that fails loses its old chunk and is tried again; an empty one is gone
    held, _ = run("c", one="one refused", two=".. note::\n   gone\n")
    assert held == {"three": 1}
    held, embedded = run("d", one="one shortened", three="three changed")
    assert held == {"one": 1, "three": 1} and embedded == {"one"}


def test_batch_ingest_writes_rejects(spark, tmp_path):
    manifest = spark.createDataFrame([tuple(m.values()) for m in MANIFEST], schemas.MANIFEST)
    raw = spark.createDataFrame(
        [("one", "text"), ("two", ".. note::\n   gone\n"), ("other", "text")], "id string, text string")
    done, rejects = write_ingest(raw, manifest, hashed_embedder(), str(tmp_path / "load"))
    assert [r.chunkId for r in done.collect()] == ["one-0000"]
    assert {tuple(r) for r in rejects.collect()} == {
        ("data/raw/two.txt", "empty after cleaning"), ("other.txt", "no manifest entry")}


def test_damaged_json_files_fail_and_are_listed(spark, tmp_path):
    whole = json.dumps(MANIFEST, indent=2)
    (tmp_path / "good.json").write_text(whole)
    (tmp_path / "cut.json").write_text(whole[:whole.index('"two"') + 9])
    (tmp_path / "other.json").write_text("no json at all")
    assert files.read_manifest(spark, str(tmp_path / "good.json")).count() == 3
    for name in ("cut.json", "other.json"):
        with pytest.raises(Exception, match="MALFORMED|CANNOT_READ|FAILED_READ"):
            files.read_manifest(spark, str(tmp_path / name)).collect()
    rejects = files.rejected_json_files(spark, str(tmp_path), schemas.MANIFEST).collect()
    assert sorted(r.file for r in rejects) == ["cut.json", "other.json"]
    assert files.rejected_json_files(spark, str(tmp_path / "good.json"), schemas.MANIFEST).count() == 0


def test_replaced_experiment_is_counted(spark, tmp_path):
    from loomdex.operators.store import replace_experiment

    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(f"c{i}", "t") for i in range(30)], "chunkId string, text string")
    first = replace_experiment(spark, path, rows, "a")
    assert first == {"before": 0, "deleted": 0, "inserted": 30, "after": 30}
    replace_experiment(spark, path, rows.limit(7), "b")
    second = replace_experiment(spark, path, rows.limit(20), "a")
    assert second == {"before": 30, "deleted": 30, "inserted": 20, "after": 20}
