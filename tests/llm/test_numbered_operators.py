"""The numbered operators against brute force, on small document records."""

import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomdex.llm import (
    bpe,
    chat_formatting,
    decontamination,
    line_dedup,
    lm_scoring,
    ngram_join,
    partitions,
    quality_classifier,
    quality_rules,
    substring_dedup,
    url_filters,
)
from loomdex.llm.queries import VOCABULARY

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCUMENT = "documentId long, text string, nLines string, class string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 7))) for _ in range(n))


BASE = prose(1, 60)
WORDS = BASE.split()
TEXTS = [
    None, "", " \t\n ", BASE, BASE, BASE.upper(), " ".join(WORDS[:30] + ["x"] + WORDS[30:]),
    " ".join(["y", *WORDS[5:]]), " ".join(WORDS[:40]) + " " + prose(2, 40),
    prose(3, 5) + " " + " ".join(WORDS[10:40]) + "  \n" + prose(4, 9), "a b c", "a b c", "A b c",
    "w " * 300, "ä ß Σίσυφος 中文 ½ \x1c<|endoftext|>x", prose(5, 3000) + " " + BASE,
    "one line\nsecond line\n\nthird", "zero\none line\n second line \nthird", "third\nthird\nthird\nthird",
    "*** " * 30 + "junk", "\n".join([prose(6, 9), prose(7, 9)]), "\n".join([prose(6, 9), prose(7, 9)]),
]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, "other", "columns") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCUMENT).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENT)


def test_bpe_equals_the_published_library(documents, nothing):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(VOCABULARY)
    rows = bpe.encode(documents, VOCABULARY, decoded=True).collect()
    for r in rows:
        ids = library.encode(TEXTS[r.documentId] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.tokenIds, "<u4").tolist() == ids and r.nTokens == len(ids)
        assert r.decodedText == library.decode(ids, skip_special_tokens=False)
    assert len(rows) == len(TEXTS) and bpe.encode(nothing, VOCABULARY).count() == 0


def test_bpe_of_random_strings():
    tokenizers = pytest.importorskip("tokenizers")
    with open(VOCABULARY, encoding="utf-8") as file:
        definition = file.read()
    codec, library = bpe.Codec(definition), tokenizers.Tokenizer.from_str(definition)
    rng = random.Random(9)
    signs = [*"abcdeghilnorst'ABΣİßé́ \n\t\x1c\x85 !?.,<|>09½中😀", "<|endoftext|>", "'ll", "tion"]
    for _ in range(3000):
        text = "".join(rng.choices(signs, k=rng.randint(0, 40)))
        assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert codec.encode("a" * 50_000).tolist() == library.encode("a" * 50_000, add_special_tokens=False).ids


def shingles(text):
    words = WORD.findall("".join(c.lower() if c in string.ascii_uppercase else c for c in text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def classes(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                    low = min(parent[a], parent[b])
                    changed |= parent[a] != low or parent[b] != low
                    parent[a] = parent[b] = low
    return sets, parent


def test_ngram_classes(spark, documents, nothing, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 3)     # groups are cut into blocks
    rng = random.Random(5)
    texts = list(TEXTS)
    for k in range(25):     # a family of near copies, linked along chains
        words = WORDS[:]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"v{k}"
        texts.append(" ".join(words))
    frame = spark.createDataFrame(list(enumerate(texts)), "documentId long, text string")
    sets, parent = classes(texts)
    for r in ngram_join.linked(frame).collect():
        assert (r.nShingles, r.componentId) == (len(sets[r.documentId]), parent[r.documentId]), r
    kept = {r.documentId for r in ngram_join.representatives(frame).collect()}
    assert kept == {i for i, p in enumerate(parent) if i == p}
    assert ngram_join.linked(nothing).count() == 0


def test_hot_shingles_are_those_of_many_documents(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_SHARE", 0.5)
    rows = [(i, BASE) for i in range(4)] + [(i, f"{prose(i, 30)} a shingle of every one") for i in range(10, 30)]
    parts = spark.sparkContext.parallelize(rows, 6)     # the copies are a part of their own
    named, hot = ngram_join._names_and_hot(spark.createDataFrame(parts, "documentId long, text string"), "bigint")
    assert named.count() == 24 and len(hot) == 1


@pytest.mark.parametrize("rows", [1, 3, 50, 10_000])
def test_groups_of_entries_in_any_batches(rows):
    """Members with a possible partner, against every pair; groups go on beyond batches."""
    rng = np.random.default_rng(3)
    shingle = np.sort(np.concatenate([rng.integers(0, 400, 600), np.full(60, 77), np.arange(1000, 1040)]))
    n = rng.integers(20, 60, len(shingle))
    room = n - rng.integers(0, 12, len(shingle))
    table = pa.table({"shingle": shingle, "id": np.arange(len(shingle)), "n": n.astype(np.int32),
                      "room": room.astype(np.int32)})
    expected = {}
    for i in range(len(shingle)):
        if any(i != j and shingle[i] == shingle[j] and min(room[i], room[j]) >= ngram_join._needed(n[i], n[j])
               for j in range(len(shingle))):
            expected.setdefault(int(shingle[i]), set()).add(i)
    found = pa.Table.from_batches(list(ngram_join._partnered(iter(table.to_batches(rows))))).to_pylist()
    groups = {}
    for r in found:
        groups.setdefault(r["shingle"], set()).add(r["id"])
        assert r["members"] == len(expected[r["shingle"]])
    assert groups == expected
    assert len({(r["who"], r["also"]) for r in found}) == len(expected)


def test_accidental_members_of_a_group_drop_out(spark):
    """Texts that share one run with near copies are not searched with them."""
    near = [BASE, " ".join([*WORDS[:-1], "other"])]
    texts = near + [f"{prose(300 + i, 28)} {' '.join(WORDS[i % 50:i % 50 + 5])} {prose(600 + i, 27)}"
                    for i in range(150)]
    frame = spark.createDataFrame(list(enumerate(texts)), "documentId long, text string")
    members, _ = ngram_join._groups(frame, "bigint", np.zeros(0, np.uint64))
    held = [(r.shingle, r.id, r.members) for r in members.collect()]
    assert {h[1] for h in held} == {0, 1} and {h[2] for h in held} == {2}
    assert len(held) == 2       # all groups of the two are the same one


def test_ngram_join_of_null_and_text_ids(spark):
    """A null documentId names no document; what it holds links with nothing."""
    other = " ".join([*WORDS[:-1], "other"])
    rows = [(None, BASE), (None, other), ("b", BASE), ("a", other), ("c", prose(9, 30)), (None, None)]
    found = ngram_join.linked(spark.createDataFrame(rows, "documentId string, text string")).collect()
    assert sorted((str(r.documentId), r.nShingles, str(r.componentId)) for r in found) == sorted([
        ("None", 56, "None"), ("None", 56, "None"), ("b", 56, "a"), ("a", 56, "a"), ("c", 26, "c"),
        ("None", 0, "None")])
    kept = ngram_join.representatives(spark.createDataFrame(rows, "documentId string, text string"))
    assert sorted(str(r.documentId) for r in kept.collect()) == ["None", "None", "None", "a", "c"]


def lines_kept(texts, run=line_dedup.RUN_LINES):
    seen, out = set(), []
    for text in texts:
        lines = (text or "").split("\n")
        places = [i for i, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for k in range(len(places) - run + 1):
            key = tuple(lines[i].strip(" \t\v\f\r") for i in places[k:k + run])
            if key in seen:
                gone.update(places[k:k + run])
            seen.add(key)
        out.append((len(places), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def test_line_dedup(documents, nothing):
    expected = lines_kept(TEXTS)
    for r in line_dedup.deduplicated(documents).collect():
        assert (r.nLines, r.nRemovedLines, r.text or "") == expected[r.documentId]
        assert r["class"] == "columns" and (r.text is None) == (TEXTS[r.documentId] is None)
    assert line_dedup.deduplicated(nothing).count() == 0
    plan = line_dedup.deduplicated(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def words_kept(texts):
    seen, out = set(), []
    for text in texts:
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - 19):
            key = tuple(words[i:i + 20])
            if key in seen:
                gone.update(range(i, i + 20))
            seen.add(key)
        out.append((len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


@pytest.mark.parametrize("shard", [500, 1])
def test_substring_dedup(documents, nothing, monkeypatch, shard):
    monkeypatch.setattr(substring_dedup, "SHARD_PASSAGES", shard)
    expected = words_kept(TEXTS)
    for r in substring_dedup.deduplicated(documents).collect():
        assert (r.nWords, r.nRemoved, r.keptText) == expected[r.documentId]
    assert substring_dedup.deduplicated(nothing).count() == 0


@pytest.mark.parametrize("shard", [500, 1])
def test_substring_dedup_keeps_rows_that_share_an_id(spark, monkeypatch, shard):
    monkeypatch.setattr(substring_dedup, "SHARD_PASSAGES", shard)
    twice = " ".join(WORDS[20:50])
    rows = [(1, BASE), (1, BASE), (2, "y " + " ".join(WORDS[5:])), (3, f"{twice} {twice}"),
            (None, prose(50, 40)), (None, prose(50, 40)), (4, "z " + prose(50, 40))]
    frame = spark.createDataFrame(rows, "documentId long, text string")
    found = sorted((r.documentId or 0, r.nRemoved) for r in substring_dedup.deduplicated(frame).collect())
    # a text that lies twice in a document goes there as a whole, as it is in document 1
    assert found == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 55), (3, 60), (4, 40)]


def test_decontamination(spark, documents, nothing):
    questions = spark.createDataFrame(
        [(1, " ".join(WORDS[5:30]), "x"), (2, prose(99, 20), "x"), (3, None, "x"), (4, "", "x"),
         (5, "third third", "x"), (1, " ".join(WORDS[5:30]), "x")],
        "id long, question string, documentId string")
    found = {(r.documentId, r.id): r for r in decontamination.contaminated(documents, questions).collect()}
    item = " ".join(WORDS[5:30])
    for i, text in enumerate(TEXTS):
        if item in " ".join((text or "").lower().split()):
            assert found[i, 1].similarity == 1.0
    assert {k for k in found if k[1] != 1} == {(18, 5)}
    clean = {r.documentId for r in decontamination.decontaminated(documents, questions).collect()}
    assert clean == set(range(len(TEXTS))) - {k[0] for k in found}
    assert decontamination.contaminated(nothing, questions).count() == 0
    assert decontamination.decontaminated(documents, questions.limit(0)).count() == len(TEXTS)


@pytest.fixture(scope="module")
def graded(spark):
    rows = [(i, prose(i, 60) if i % 2 else "### " * 40 + prose(i, 20).upper(), i % 2) for i in range(200)]
    frame = spark.createDataFrame(rows, "documentId long, text string, quality int").cache()
    return frame, frame.select("documentId", "quality")


def test_neighbours_vote(documents, nothing, graded):
    frame, labels = graded
    train = labels.filter("documentId % 3 <> 1")
    model = quality_classifier.fit(frame, train)
    rows = quality_classifier.score(frame, model).join(labels, "documentId").filter("documentId % 3 = 1").collect()
    assert np.mean([(r.score >= 0.5) == r.quality for r in rows]) >= 0.95
    scores = [r.score for r in quality_classifier.score(documents, model).collect()]
    assert len(scores) == len(TEXTS) and all(0 <= s <= 1 for s in scores)
    empty = quality_classifier.fit(nothing, labels.limit(0))
    assert {r.score for r in quality_classifier.score(documents, empty).collect()} == {0.5}


def test_quality_rules(documents, nothing, graded):
    model = quality_rules.fit(*graded)
    for r in quality_rules.judged(documents, model).collect():
        text = TEXTS[r.documentId] or ""
        words = WORD.findall(text)
        runs = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        again = {j for i in range(len(words) - 7) if runs[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.nWords, r.wordChars, r.nSymbols, r.nDupLines, r.nRepeatWords) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(again))
        assert r.baseFailed == (len(words) < 20 or 100 * len(again) > 30 * len(words))
        assert not (r.kept and r.baseFailed) and 0 <= r.probability <= 1
    judged = quality_rules.judged(graded[0], model).join(graded[1], "documentId").collect()
    assert np.mean([r.kept == bool(r.quality) for r in judged]) >= 0.95
    assert quality_rules.fit(nothing, graded[1]) is None
    assert quality_rules.judged(documents, None).filter("kept = baseFailed").count() == 0
    kept = {r.documentId for r in quality_rules.kept(documents, model).collect()}
    assert kept == {r.documentId for r in quality_rules.judged(documents, model).filter("kept").collect()}


def test_url_verdicts(spark):
    rules = spark.createDataFrame(
        [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
         ("net/es/", "block"), (None, "block")], "rule string, verdict string")
    cases = [
        (None, "", "", None, "allow"), ("no address", "", "", None, "allow"),
        ("http://", "", "", None, "allow"), ("http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"),
        ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://x.com", "x.com", "", None, "allow"), ("https://x.com?en/", "x.com", "", None, "allow"),
        ("https://xcom/", "xcom", "/", None, "allow"), ("ftp://b.net/es/é#x", "b.net", "/es/é", "net/es/", "block"),
        ("http://b.net/es", "b.net", "/es", None, "allow"), ("http://c.com/http://b.net/es/", "c.com", "/http://b.net/es/", "com/", "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(cases)], "documentId long, sourceUrl string, rule string")
    for r in url_filters.verdicts(pages, rules).collect():
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.documentId][1:]
    assert url_filters.verdicts(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filters.verdicts(pages, rules.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.xxhash64("id").alias("a"), F.xxhash64(F.lit(1), "id").alias("b"), "id")
    listed = universe.filter("id % 50 = 3").select("a", "b")
    levels = url_filters.cascade(listed, universe.select("a", "b"))
    rows = universe.toPandas()
    found = url_filters._members(levels, rows.a.to_numpy(), rows.b.to_numpy())
    assert len(levels) > 1 and (found == (rows.id % 50 == 3)).all()


def test_language_models(spark, documents, nothing):
    target = spark.createDataFrame([(BASE,), (None,), ("",)], "text string")
    models = lm_scoring.fit(target, documents)
    assert models.words.shape[1] == len(models.known) + 1
    rows = {r.documentId: r for r in lm_scoring.score(documents, models).collect()}
    assert rows[3].score < rows[20].score and rows[0].score is None and rows[0].nWords == 0
    total = sum(len(re.findall(r"[^\W_]+", (t or "").lower())) for t in TEXTS[3:14])
    assert total == sum(rows[i].nWords for i in range(3, 14))
    assert lm_scoring.score(nothing, models).count() == 0
    assert lm_scoring.score(documents, lm_scoring.fit(target.limit(0), nothing)).count() == len(TEXTS)


def cheapest(roles):
    import heapq

    done, heap = {}, [(0, 0, 0)]
    while heap:
        cost, i, last = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done[i, last] = cost
        if i == len(roles) and last in (2, 3):
            return cost
        for b in chat_formatting.FOLLOWING[last] if i < len(roles) else ():
            heapq.heappush(heap, (cost + chat_formatting.INSERT, i, b))
        for b in (1, 2, 3) if i < len(roles) else ():
            own = 0 if b == roles[i] else 1 if roles[i] == 0 else chat_formatting.RELABEL
            if b in chat_formatting.FOLLOWING[last]:
                heapq.heappush(heap, (cost + own, i + 1, b))
            if b == last:
                heapq.heappush(heap, (cost + own + chat_formatting.MERGE, i + 1, b))


def test_chat_repair(spark, monkeypatch):
    monkeypatch.setattr(chat_formatting, "RANGE_TURNS", 4)      # long conversations are cut
    rng = random.Random(3)
    names, rows, expected = [None, "system", " User", "assistant"], [], {}
    for k in range(60):
        roles = [rng.randint(0, 3) for _ in range(rng.choice([1, 2, 3, 8, 70]))]
        expected[k] = cheapest(roles)
        rows += [(k, i, names[r], rng.choice([None, "", "t<|im_end|>"]), "x") for i, r in enumerate(roles)]
    turns = spark.createDataFrame(rows, "id long, turn long, role string, text string, cost string")
    found = chat_formatting.repaired(turns).toPandas().sort_values(["id", "turn"])
    assert found.groupby("id").cost.sum().to_dict() == expected and len(found) == len(rows)
    for _, group in found.groupby("id"):
        text, last = "".join(group.rendered), 0
        for role in re.findall(r"<\|im_start\|>(\w+)\n", text):
            assert chat_formatting.ROLES.index(role) in chat_formatting.FOLLOWING[last]
            last = chat_formatting.ROLES.index(role)
        assert text.endswith("<|im_end|>\n") and text.count("<|im_start|>") == text.count("<|im_end|>")
    assert chat_formatting.repaired(turns.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None, "user", "b", ""), (None, 1, "user", "a", "")], turns.schema)
    assert [r.action for r in chat_formatting.repaired(odd).orderBy(F.col("turn").asc_nulls_last()).collect()] == ["keep", "merge"]


def losses(texts, corpora):
    """Per text: mean losses of bigram models with every word and pair of all corpora."""
    split = [[re.findall(r"[^\W_]+", (t or "").lower()) for t in c] for c in corpora]
    singles = [Counter(w for t in c for w in t) for c in split]
    doubles = [Counter(p for t in c for p in zip(t, t[1:])) for c in split]
    vocabulary, totals = len(set().union(*singles)), [sum(c.values()) for c in singles]
    for text in texts:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        sums = [0.0, 0.0]
        for m, (single, double) in enumerate(zip(singles, doubles)):
            for before, word in zip([None, *words], words):
                chance = (single[word] + 0.5) / (totals[m] + 0.5 * (vocabulary + 1))
                if before is not None and single[before]:
                    chance = 0.6 * double[before, word] / single[before] + 0.4 * chance
                sums[m] -= np.log(chance)
        yield [s / len(words) for s in sums] if words else [None, None]


def test_language_models_count_every_word_and_pair(spark):
    # more words than 2^16, and the rare ones of one model are not those of the other
    texts = [" ".join(f"w{k}x{i} common" for i in range(2000)) for k in range(40)] + [None, "", "w1x1 w2x2"]
    goal = ["w1x1 common w1x2 common", "t1 t2 t3 w39x1999 common", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "documentId long, text string")
    models = lm_scoring.fit(spark.createDataFrame([(t,) for t in goal], "text string"), rows)
    assert models.sums[0] == 80_001 + 3
    other = [*texts[:3], "never seen words w1x1 common", "common common t1 t2", None]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(other)], "documentId long, text string")
    for frame, pairs in ((rows, losses(texts, (goal, texts))), (asked, losses(other, (goal, texts)))):
        found = sorted(lm_scoring.score(frame, models).collect())
        for r, pair in zip(found, pairs, strict=True):
            expected = pair if pair[0] is None else pytest.approx(pair, rel=1e-9)
            assert [r.targetLoss, r.backgroundLoss] == expected, r.documentId


def test_substring_dedup_cuts_frequent_passages_again(spark, monkeypatch):
    """Few windows of passages around a frequent run are compared as a whole, and made once."""
    monkeypatch.setattr(substring_dedup, "SHARD_PASSAGES", 4)
    tables, written = [], substring_dedup.written
    monkeypatch.setattr(substring_dedup, "written", lambda rows: tables.append(written(rows)) or tables[-1])
    texts = [f"{prose(100 + i, 15)} {' '.join(WORDS[:24])} {prose(200 + i, 15)}" for i in range(30)]
    frame = spark.createDataFrame(list(enumerate(texts)), "documentId long, text string")
    expected = words_kept(texts)
    for r in substring_dedup.deduplicated(frame).collect():
        assert (r.nWords, r.nRemoved, r.keptText) == expected[r.documentId]
    frequent = next(t for t in tables if {"passage", "different"} <= set(t.columns)).filter("different > 4")
    words = frequent.select(F.sum(F.size(F.split("passage", " ")) - 19)).first()[0]
    split = [t.count() for t in tables if "window" in t.columns]
    assert len(split) == 1 and 0 < split[0] < words


def test_rows_that_share_an_id_lose_their_own_repeats_only(spark):
    passage, own, more = prose(40, 30), prose(41, 60), prose(42, 200)
    rows = [(1, passage), (2, prose(43, 10)), (2, own + " " + passage), (2, more + " " + passage),
            (2, more + " " + passage), (None, passage), (3, own)]
    frame = spark.createDataFrame(rows, "documentId long, text string")
    found = substring_dedup.deduplicated(frame).collect()
    # null is smaller than any id, so that row has the passage first
    assert sorted((r.documentId or -1, r.keptText) for r in found) == sorted([
        (-1, passage), (1, ""), (2, rows[1][1]), (2, own), (2, more), (2, more), (3, "")])


def test_line_rows_that_share_an_id_and_clashing_names(spark):
    names = ["row", "start", "starts", "made", "input", "hashes", "_id", "_starts", "_made", "place"]
    rows = [(1, "a\nb\nc"), (2, "x\ny\nz"), (2, "q\na\nb"), (None, "k\nl"), (3, "k\nl\nm"), (4, None)]
    frame = spark.createDataFrame(
        [(i, t, *names) for i, t in rows],
        "documentId long, text string, " + ", ".join(f"{n} string" for n in names))
    found = line_dedup.deduplicated(frame)
    assert found.columns == [*frame.columns, "nLines", "nRemovedLines"]
    assert sorted((r.documentId or -1, r.text or "") for r in found.collect()) == [
        (-1, "k\nl"), (1, "a\nb\nc"), (2, "q"), (2, "x\ny\nz"), (3, "m"), (4, "")]
    assert all([r[n] for n in names] == names for r in found.collect())


def weighted_similarities(documents, questions):
    """Per pair the best weighted Jaccard similarity of a window of the question's length."""
    cut = lambda text: re.findall("[a-z0-9]+", (text or "").lower())
    sets = lambda words: {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
    held = Counter(s for _, q in questions for s in sets(cut(q)))
    weight = lambda shingles: sum(np.log1p(len(questions) / held.get(s, 1)) for s in shingles)
    best = {}
    for d, text in documents:
        words = cut(text)
        for q, question in questions:
            own, n = sets(cut(question)), len(cut(question))
            for i in range(max(1, len(words) - n + 1)):
                window = sets(words[i:i + n])
                if both := own & window:
                    found = weight(both) / weight(own | window)
                    best[d, q] = max(best.get((d, q), 0.0), found)
    return best


@pytest.mark.parametrize("block_bytes", [3000, decontamination.BLOCK_BYTES])
def test_decontamination_of_near_copies_in_any_number_of_blocks(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block_bytes)
    rng = random.Random(8)
    common = prose(50, 6)
    questions = [(f"q{i}", prose(100 + i, 24) + " " + common) for i in range(12)]
    documents = []
    for i, (_, question) in enumerate(questions):
        words = question.split()
        for changed in range(3):
            copy = list(words)
            for place in rng.sample(range(len(copy)), changed):
                copy[place] = "changed"
            documents.append((10 * i + changed, prose(200 + i, 20) + " " + " ".join(copy) + " " + prose(300 + i, 9)))
    documents += [(900, common), (901, None), (902, prose(60, 300))]
    found = decontamination.contaminated(
        spark.createDataFrame(documents, "documentId long, text string"),
        spark.createDataFrame(questions, "id string, question string"))
    best = {k: v for k, v in weighted_similarities(documents, questions).items() if v >= 0.75}
    assert {(r.documentId, r.id): r.similarity for r in found.collect()} == pytest.approx(best)
    assert 12 < len(best) < 36


def test_passages_are_filtered_in_the_worker_that_makes_them(documents, spark):
    """No Python worker feeds another one: each more takes memory of an executor per task."""
    plan = substring_dedup.deduplicated(documents)._jdf.queryExecution().executedPlan()
    assert "MapInArrow" in plan.toString()
    lines = [x.strip(" :+-") for x in plan.toString().splitlines()]
    arrows = [i for i, line in enumerate(lines) if line.lstrip("*(0123456789) ").startswith("MapInArrow")]
    for i in arrows:
        below = next(x for x in lines[i + 1:] if not x.lstrip("*(0123456789) ").startswith("Project"))
        assert not below.lstrip("*(0123456789) ").startswith("MapInArrow")


def test_hashed_filter_never_drops_a_member(spark):
    ids = np.random.default_rng(3).integers(-2**63, 2**63 - 1, 4000)
    frame = spark.createDataFrame([(int(i),) for i in ids[:2000]], "id long")
    found = partitions.IdFilter(frame, 1 << 20, hashed=True).test()(ids)
    assert found[:2000].all() and found[2000:].sum() < 20
