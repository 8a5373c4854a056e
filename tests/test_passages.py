import random

from loomdex.operators.passages import containing_documents


def found(spark, texts, passages):
    docs = spark.createDataFrame(list(enumerate(texts)), "documentId long, text string")
    asked = spark.createDataFrame(list(enumerate(passages)), "id long, question string")
    rows = containing_documents(docs, asked).select("id", "documentId").collect()
    assert len(rows) == len(set(rows))
    return set(map(tuple, rows))


def expected(texts, passages):
    return {(p, d) for p, passage in enumerate(passages) for d, text in enumerate(texts)
            if passage and text is not None and passage in text}


def test_passages_of_every_kind_against_brute_force(spark):
    draw = random.Random(5)
    words = ["ab", "b", "c,", "ä", "xyz", "😀e", "ab"]
    spaces = [" ", "  ", "\n", "\t", "\x0b"]
    texts = ["".join(w for _ in range(draw.choice([0, 1, 5, 40, 200]))
                     for w in (draw.choice(words), draw.choice(spaces))) for _ in range(60)]
    texts += [None, "", "w" * 5000, texts[9], texts[9]]
    passages = [None, "", " ", "\n\n", "\t ", "w" * 40, "😀", "a", "nowhere in any of these texts at all", " "]
    for _ in range(200):
        text = draw.choice([t for t in texts if t])
        at = draw.randrange(len(text))
        passages.append(text[at:at + draw.choice([1, 2, 3, 4, 8, 20, 60, 200])])
    passages += passages[-3:]
    want = expected(texts, passages)
    assert len(want) > 500
    assert found(spark, texts, passages) == want


def test_shared_beginnings_and_empty_tables(spark):
    head = " ".join(f"w{i}" for i in range(30))
    texts = [f"{head} end{i}" for i in range(20)] + [head]
    passages = [f"{head} end{i}" for i in range(20)] + [f"{head} end"]
    assert found(spark, texts, passages) == expected(texts, passages)
    assert found(spark, texts, []) == found(spark, [], passages) == found(spark, [None], [None]) == set()


def test_texts_stay_where_few_documents_can_contain_a_passage(spark):
    """The candidates' size is known, so no text is shuffled to them."""
    docs = spark.range(20000).selectExpr(
        "id as documentId", "concat_ws(' ', transform(sequence(1, 60), i -> concat('w', i * (id + 1)))) as text")
    asked = docs.filter("documentId < 5").selectExpr("documentId as id", "left(text, 120) as question")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "200000")
    try:
        found = containing_documents(docs, asked)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {tuple(r) for r in found.select("id", "documentId").collect()} >= {(i, i) for i in range(5)}
    finally:
        spark.conf.set(threshold, before)


def test_both_experiments_read_the_same_questions(spark):
    from loomdex.plans import given_tables

    rows = given_tables.experiment_rows(spark, "/root/testdata/sf0.001")
    assert "Contains(" not in rows._jdf.queryExecution().optimizedPlan().toString()
