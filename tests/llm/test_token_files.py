"""Token-id files against the published library, and the pair grammar against its input."""

import itertools
import random
import string
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomdex.llm import token_files
from loomdex.llm.pair_grammar import Grammar
from loomdex.llm.queries import BYTE_VOCABULARY
from loomdex.session import shared_folder

tokenizers = pytest.importorskip("tokenizers")
LIBRARY = tokenizers.Tokenizer.from_file(BYTE_VOCABULARY)
TEXTS = [
    None, "", " ", "a", "don't we're  two blanks \n line\n\nend ", "same same same " * 400,
    "x y z　 w \x1c v\x85 u", "Σίσυφος 中文 ½ <|endoftext|> after", "0" * 70_000,
    "tab\tand  \t blank", "same text", "same text",
]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=400))
def test_grammar_gives_back_its_ids(ids):
    made = Grammar.from_bytes(Grammar.of(np.array(ids, np.uint32)).to_bytes())
    assert made.ids().tolist() == ids
    for a, b in ((0, 1), (len(ids) // 3, 2 * len(ids) // 3), (len(ids) - 1, len(ids) + 9), (7, 5)):
        assert made.ids(max(0, a), b).tolist() == ids[max(0, a):b]


def test_grammar_shrinks_runs_and_copies():
    own = list(np.random.default_rng(3).integers(0, 50_000, 1000))
    for ids in (own * 64, [0] * 100_000):
        made = Grammar.of(np.array(ids, np.uint32))
        assert len(made.symbols) + 2 * len(made.left) < len(ids) / 8
        assert made.ids().tolist() == ids
    with pytest.raises(ValueError):
        Grammar.from_bytes(made.to_bytes()[:-4])


def test_pieces_equal_whole_texts():
    encoder = token_files.PieceEncoder(open(BYTE_VOCABULARY, encoding="utf-8").read())
    assert encoder.cuts
    rng = random.Random(5)
    signs = [*"ab'sdt. ,1½é中 \n\t\x1c\x85   \r", "'ll", "<|endoftext|>", "  ", "word "]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(4000)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(text)[:-1], repr(text)
    words = token_files.PieceEncoder(
        open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    assert not words.cuts


def test_known_pieces_are_not_encoded_again(monkeypatch):
    encoder = token_files.PieceEncoder(open(BYTE_VOCABULARY, encoding="utf-8").read())
    words = ["".join(p) for p in itertools.product("abé", "xy1", "oß9")]
    signs = [". ", ",(", "-", "..\n", "| ", "@"]
    encoder.encode(["x " + "".join(w + s + v + " " for s, w, v in zip(signs * 27, words * 6, words * 6))
                    + " ".join(words) + "".join(f" a{s[0]}{w}" for s in signs for w in words)])
    seen = []
    whole = encoder._whole
    monkeypatch.setattr(encoder, "_whole", lambda texts: seen.extend(texts) or whole(texts))
    text = "x " + " ".join(w + s[0] + v for w in words for s in signs for v in words)
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == ids_of(text)[:-1]
    assert sum(map(len, seen)) < 10     # the first word and the end of a string; all else was met


def test_signs_behind_every_character_and_a_small_memory(monkeypatch):
    encoder = token_files.PieceEncoder(open(BYTE_VOCABULARY, encoding="utf-8").read())
    signs = [*string.punctuation, "'s", "'s.", ".'s", "\x85.", ".\t,", "\0", " a\0 a "]
    texts = [f"x {chr(c)}{s}a {s}{chr(c)}{s} \n{chr(c)}1{s}é" for c in [*range(0x300), 0x4E2D, 0x1F600]
             for s in signs]
    for most in (token_files._REMEMBERED, 2000, 0):
        monkeypatch.setattr(token_files, "_REMEMBERED", most)
        for some in (texts[::7], texts[3::11], texts[:40], ["", "a"], []):
            assert [np.frombuffer(i, "<u4").tolist() for i in encoder.encode(some)] == [
                ids_of(t)[:-1] for t in some]
    assert len(encoder.known) == 1
    words = token_files.PieceEncoder(
        open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    assert [len(i) > 0 for i in words.encode(["two words.", ""])] == [True, False]


@pytest.mark.parametrize("shard_ids", [1, 500, token_files.SHARD_IDS])
def test_store_in_order_with_ranges(spark, shard_ids):
    order = list(range(len(TEXTS)))
    random.Random(1).shuffle(order)
    rows = spark.createDataFrame(
        [(i, TEXTS[i], "other") for i in order], "documentId long, text string, start string")
    path = f"{shared_folder(spark)}/store-{shard_ids}-{random.random()}"
    token_files.write(rows.repartition(3), BYTE_VOCABULARY, path, shard_ids=shard_ids)
    found = sorted(token_files.read(spark, path).collect())
    every = [ids_of(t) for t in TEXTS]
    starts = np.cumsum([0, *map(len, every)]).tolist()
    assert [(r.documentId, r.start, r.nTokens) for r in found] == [
        (i, starts[i], len(every[i])) for i in range(len(TEXTS))]
    for r, ids in zip(found, every):
        assert zlib.crc32(r.tokenIds) == zlib.crc32(np.array(ids, "<u4").tobytes())
    joined = [i for ids in every for i in ids]
    for start, n in ((0, 3), (starts[4] - 2, 40), (starts[-1] - 5, 100), (starts[-1] + 1, 4)):
        parts = sorted(token_files.read_range(spark, path, start, n).collect())
        assert [i for r in parts for i in np.frombuffer(r.tokenIds, "<u4").tolist()] == joined[start:start + n]


def test_store_of_null_and_repeated_ids(spark):
    rows = [(None, "n"), (2, "b"), (2, "a"), (2, "a"), (1, None)] + [(7, f"t{i % 5}") for i in range(300)]
    path = f"{shared_folder(spark)}/store-{random.random()}"
    token_files.write(spark.createDataFrame(rows, "documentId long, text string"), BYTE_VOCABULARY, path)
    found = token_files.read(spark, path).orderBy("start").collect()
    assert sorted((r.documentId or -1, LIBRARY.decode(np.frombuffer(r.tokenIds, "<u4").tolist()[:-1]))
                  for r in found) == sorted((i or -1, t or "") for i, t in rows)
    assert [r.documentId or -1 for r in found] == sorted(i or -1 for i, _ in rows)
    assert all(a.start + a.nTokens == b.start for a, b in zip(found, found[1:]))


def test_empty_store(spark):
    path = f"{shared_folder(spark)}/store-{random.random()}"
    token_files.write(spark.createDataFrame([], "documentId string, text string"), BYTE_VOCABULARY, path)
    assert token_files.read(spark, path).collect() == []
    assert token_files.read_range(spark, path, 0, 5).collect() == []
