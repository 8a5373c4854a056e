import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.operators import store, validation

SCHEMA = T.StructType([
    T.StructField("chunkId", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])


def rows(spark, *pairs):
    return spark.createDataFrame([(k, t, [1.0, 2.0]) for k, t in pairs], SCHEMA)


def content(frame):
    return sorted((r.chunkId, r.text) for r in frame.collect())


def test_upsert_is_idempotent(spark):
    old = rows(spark, ("a", "1"), ("b", "2"))
    new = rows(spark, ("b", "changed"), ("c", "3"))
    once = store.upserted(old, new)
    assert content(once) == [("a", "1"), ("b", "changed"), ("c", "3")]
    assert content(store.upserted(once, new)) == content(once)


def test_upsert_counts(spark):
    old = rows(spark, ("a", "1"), ("b", "2"))
    new = rows(spark, ("a", "1"), ("b", "changed"), ("c", "3"))
    assert tuple(store.upsert_counts(old, new).first()) == (1, 2, 1)


def test_keys_repeated_in_a_batch_count_once(spark):
    old, new = rows(spark, ("a", "0")), rows(spark, ("a", "1"), ("a", "2"), ("b", "2"), ("b", "1"))
    assert content(store.upserted(old, new)) == [("a", "2"), ("b", "2")]
    assert tuple(store.upsert_counts(old, new).first()) == (1, 1, 1)
    timed = new.withColumn("at", -F.col("text").cast("int"))
    kept = store.one_per_key(timed, order="at")
    assert content(kept) == [("a", "1"), ("b", "1")]


def test_stored_table(spark, tmp_path):
    path = str(tmp_path / "table")
    first = rows(spark, *[(f"k{i}", "old") for i in range(200)])
    store.upsert_table(spark, path, first, "chunk-300", shards=8)
    store.upsert_table(spark, path, rows(spark, ("k5", "new"), ("z", "new")), "chunk-300", shards=8)
    store.upsert_table(spark, path, rows(spark, ("k5", "other")), "chunk-800", shards=8)
    stored = store.read_store(spark, path, SCHEMA)
    by_experiment = {r.experiment: r["count"] for r in stored.groupBy("experiment").count().collect()}
    assert by_experiment == {"chunk-300": 201, "chunk-800": 1}
    assert content(stored.filter("text = 'new'")) == [("k5", "new"), ("z", "new")]

    # replacing one experiment leaves no old shard behind and the other one alone
    store.replace_experiment(spark, path, rows(spark, ("only", "x")), "chunk-300", shards=8)
    stored = store.read_store(spark, path, SCHEMA)
    assert content(stored) == [("k5", "other"), ("only", "x")]


def test_duplicate_keys_in_a_batch_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        store.upsert_table(spark, str(tmp_path / "t"), rows(spark, ("a", "1"), ("a", "2")), "x")


def test_input_errors(spark):
    records = spark.createDataFrame(
        [("a", "x", [1.0]), ("a", " ", []), ("a", "y", None), (None, "z", [1.0]), ("", "z", [1.0]),
         ("b", None, [1.0])], SCHEMA,
    )
    found = {tuple(r) for r in validation.input_errors(records).collect()}
    assert found == {
        (None, "missing id", 2), ("a", "duplicate id", 2), ("a", "missing vector", 2),
        ("a", "blank text", 1), ("b", "blank text", 1),
    }


def test_checks(spark):
    good = rows(spark, ("a", "1"), ("b", "2"))
    assert validation.store_verdict(good, dimension=2, expected=2).first().passed
    assert not validation.store_verdict(good, dimension=2, expected=3).first().passed
    assert not validation.store_verdict(good, dimension=3).first().passed
    assert validation.vector_table_check(good, expected=2).first().complete
    mixed = good.unionByName(spark.createDataFrame([("c", "3", [1.0])], SCHEMA))
    check = validation.vector_table_check(mixed, expected=3).first()
    assert (check.consistent, check.dimension, check.complete) == (False, None, False)
    assert validation.dimension_check(mixed).first().dimensions == 2
    empty = validation.store_verdict(good.limit(0), dimension=2).first()
    assert (empty.count_ok, empty.passed) == (False, False)
    twice = good.unionByName(rows(spark, ("a", "1")))
    assert validation.duplicate_groups(twice).first()[0] == 1
    assert tuple(validation.duplicate_ids(twice).first()) == (3, 2, 1)


def test_chunk_table_check(spark):
    chunks = good = spark.createDataFrame(
        [("a", "x", 800, 100), ("b", "y", 300, 50)],
        "chunkId string, text string, chunkSize int, overlap int",
    )
    assert not validation.chunk_table_check(chunks, 800, 100).first().ok
    assert validation.chunk_table_check(good.filter("chunkSize = 800"), 800, 100).first().ok


def test_swap_counts_and_first_rows(spark):
    stored = rows(spark, ("a", "1")).withColumn("experiment", F.lit("x")).unionByName(
        rows(spark, ("k", "1"), ("l", "1"), ("m", "1")).withColumn("experiment", F.lit("y")))
    new = rows(spark, ("b", "1"), ("c", "1"))
    counts = {tuple(r) for r in store.swap_counts(stored, new, "x").collect()}
    assert counts == {("x", 1, 1, 2, 2), ("y", 3, 0, 0, 3)}
    assert content(store.swapped(stored, new, "x")) == [
        ("b", "1"), ("c", "1"), ("k", "1"), ("l", "1"), ("m", "1")]
    chunks = spark.createDataFrame([("d2", 0), ("d1", 1), ("d1", 0)], "documentId string, chunkIndex int")
    assert [tuple(r) for r in store.first_rows(chunks, 2).collect()] == [("d1", 0), ("d1", 1)]
    with pytest.raises(ValueError):
        store.first_rows(chunks, 0)
    assert store.with_shard(rows(spark, ("a", "1"))).select(F.col("shard").between(0, store.SHARDS - 1)).first()[0]


def test_versions_and_digests(spark, tmp_path):
    path = str(tmp_path / "table")
    first = rows(spark, *[(f"k{i}", "old") for i in range(100)])
    assert store.upsert_table(spark, path, first, "a", shards=8) == {
        "inserted": 100, "matched": 0, "replaced": 0, "deleted": 0}
    opened = store.read_store(spark, path, SCHEMA)

    # unchanged rows write nothing, a changed row writes its shard only
    files = sorted(p for p in (tmp_path / "table").rglob("*.parquet"))
    assert store.upsert_table(spark, path, first.limit(40), "a", shards=8) == {
        "inserted": 0, "matched": 40, "replaced": 0, "deleted": 0}
    assert sorted(p for p in (tmp_path / "table").rglob("*.parquet")) == files
    batch = rows(spark, ("k1", "new"), ("k2", "old"))
    gone = spark.createDataFrame([("k3",), ("k1",), ("unknown",)], "chunkId string")
    kept = store.upsert_counts(first, batch).first()
    counts = store.upsert_table(spark, path, batch, "a", shards=8, removed=gone)
    assert counts == {**kept.asDict(), "deleted": 1} == {
        "inserted": 0, "matched": 2, "replaced": 1, "deleted": 1}
    touched = store.with_shard(rows(spark, ("k1", ""), ("k3", "")), shards=8).select("shard").distinct()
    new = store.store_manifest(spark, path).filter("data_version = 2").select("shard")
    assert set(new.collect()) == set(touched.collect())
    now = store.read_store(spark, path, SCHEMA)
    assert content(now) == sorted([(f"k{i}", "old") for i in range(100) if i not in (1, 3)] + [("k1", "new")])
    assert now.columns == ["chunkId", "text", "embedding", "experiment", "shard"]

    # readers keep the version they opened, and older ones can be opened
    assert content(opened) == content(first) == content(store.read_store(spark, path, SCHEMA, version=1))
    old = store.superseded_shards(spark, path, keep_from=2)
    assert set(old.select("version", "shard").collect()) == set(touched.selectExpr("1L AS version", "shard").collect())
    with pytest.raises(ValueError, match="version 9"):
        store.superseded_shards(spark, path, keep_from=9)


def test_a_load_that_dies_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    store.upsert_table(spark, path, rows(spark, ("a", "1"), ("b", "1")), "x", shards=4)
    broken = rows(spark, ("a", "2")).withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.replace_experiment(spark, path, broken, "x", shards=4)
    assert content(store.read_store(spark, path, SCHEMA)) == [("a", "1"), ("b", "1")]

    # rows and manifest are written, the commit is not
    with monkeypatch.context() as patch:
        patch.setattr(store, "_COMMIT", T.StructType([T.StructField("version", T.BooleanType())]))
        patch.setattr(store, "store_version", lambda *_: 1)
        with pytest.raises(Exception):
            store.replace_experiment(spark, path, rows(spark, ("lost", "2"), ("more", "2")), "x", shards=4)
    assert content(store.read_store(spark, path, SCHEMA)) == [("a", "1"), ("b", "1")]
    counts = store.replace_experiment(spark, path, rows(spark, ("c", "3")), "x", shards=4)
    assert counts == {"before": 2, "deleted": 2, "inserted": 1, "after": 1}
    assert content(store.read_store(spark, path, SCHEMA)) == [("c", "3")]
    # an experiment may become empty
    assert store.replace_experiment(spark, path, rows(spark, ("c", "3")).limit(0), "x")["after"] == 0
    assert content(store.read_store(spark, path, SCHEMA)) == []


def test_digests_tell_nulls_and_places(spark):
    made = spark.createDataFrame(
        [("a", None, "x"), ("b", "x", None), ("c", "", "x"), ("d", "x", "")], "chunkId string, s string, t string")
    lists = spark.createDataFrame([("a", [1.0, None]), ("b", [None, 1.0]), ("c", [1.0])], "chunkId string, v array<float>")
    for frame in (made, lists):
        digests = [r[store.DIGEST] for r in store.with_digest(frame).collect()]
        assert len(set(digests)) == len(digests) and None not in digests


def test_experiment_names_are_folder_names(spark, tmp_path):
    with pytest.raises(ValueError, match="experiment names"):
        store.upsert_table(spark, str(tmp_path / "t"), rows(spark, ("a", "1")), "a/b")
