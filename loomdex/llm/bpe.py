"""Byte-pair encoding and decoding of whole document texts with a published vocabulary.

Every prefix of a piece has exactly one last token in its byte-pair encoding. The
tokens that end at a position are found by running the piece through a suffix
automaton of the vocabulary; the last token of a prefix is the one whose pair with
the last token of the shorter prefix survives undoing the merges. Back-pointers from
the end give the ids. No merge loop runs over a text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomdex.llm.suffix_automaton import EntryAutomaton
from loomdex.llm.word_arrays import memory_returned, slices

MAX_VOCABULARY_BYTES = 64 << 20     # larger files are refused: the vocabulary is broadcast
CACHED_PIECES = 400_000             # remembered by a task before it starts afresh
CACHED_PAIRS = 300_000
_PAIR = 1 << 20                     # a pair of ids as one number
_FINAL = 0x10000                    # added to a character that ends a word
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_BEYOND_LATIN = re.compile("[^\n\t\r -~\xa1-\u024f]")


class Codec:
    """Encoder and decoder of a byte-level vocabulary with word ends."""

    def __init__(self, definition: str) -> None:
        import regex

        spec = json.loads(definition)
        model = spec["model"]
        end = model["end_of_word_suffix"]
        vocabulary: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = regex.compile(
            spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], regex.V0)
        self.splitter = re.compile(
            "(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.definition, self.library = definition, None
        #: Bytes outside the printable ones are shown as characters from U+0100 on.
        hidden = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
        self.shown = {b: 0x100 + i for i, b in enumerate(hidden)}

        def symbols(token: str) -> str:
            if not token.endswith(end):
                return token
            body = token[: -len(end)]
            return body[:-1] + chr(ord(body[-1]) + _FINAL)

        ids = {symbols(token): i for token, i in vocabulary.items()}
        #: Merge order; tokens of one symbol come first.
        self.rank: dict[int, int] = {i: -1 for s, i in ids.items() if len(s) == 1}
        self.pair: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for order, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            whole = ids[symbols(a + b)]
            self.pair[vocabulary[a] * _PAIR + vocabulary[b]] = order
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (vocabulary[a], vocabulary[b]), order
        self.automaton = EntryAutomaton({s: i for s, i in ids.items() if i in self.rank})
        self.known: dict[str, tuple[int, ...]] = {}
        self.compatible: dict[int, bool] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether byte-pair encoding leaves this pair of neighbours as it is.

        The merges of both tokens are undone, the later one first. A pair across the
        border that merges before a merge which was undone would have come first.
        """
        pair, rank, parts = self.pair, self.rank, self.parts
        limit, on_tie = 1 << 60, True       # order of the last undone merge; ties are earlier
        while True:
            order = pair.get(left * _PAIR + right)
            if order is not None and (order < limit or on_tie and order == limit):
                return False
            a, b = rank[left], rank[right]
            if a > b:
                limit, on_tie, left = a, False, parts[left][1]
            elif b >= 0:
                limit, on_tie, right = b, True, parts[right][0]
            else:
                return True

    def piece_ids(self, text: str) -> list[int]:
        """The ids of one piece: last token of every prefix, then the back-pointers.

        ``text``: the piece in byte characters, its last one marked as final.
        """
        automaton, compatible = self.automaton, self.compatible
        following, link, length = automaton.next, automaton.link, automaton.length
        ending = automaton.ending
        last, sizes = [-1], [0]
        state = matched = 0
        for i, c in enumerate(text, 1):
            after = following[state].get(c)
            while after is None:
                state = link[state]
                matched = length[state]
                after = following[state].get(c)
            state = after
            matched += 1
            for size, token in ending[state]:
                if size > matched:
                    continue
                if size == i:
                    break
                key = last[i - size] * _PAIR + token
                fits = compatible.get(key)
                if fits is None:
                    fits = compatible[key] = self.fits(last[i - size], token)
                if fits:
                    break
            last.append(token)
            sizes.append(size)
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= sizes[at]
        return out[::-1]

    def piece(self, piece: str, shown: bool = False) -> tuple[int, ...]:
        """Ids of a piece that was not met before; ``shown``: it has byte characters already."""
        if len(self.compatible) >= CACHED_PAIRS:
            self.compatible.clear()
        text = piece
        if not shown and not piece.isascii():
            text = piece.encode().decode("latin-1").translate(self.shown)
        return tuple(self.piece_ids(text[:-1] + chr(ord(text[-1]) + _FINAL)))

    def latin_ids(self, text: str) -> list[int]:
        """Latin letters have had the same properties in all versions and are composed."""
        ids: list[int] = []
        known = self.known
        for piece in self.pieces.findall(text.lower()):
            found = known.get(piece)
            if found is None:
                if len(known) >= CACHED_PIECES:
                    known.clear()
                found = known[piece] = self.piece(piece)
            ids += found
        return ids

    def library_pieces(self, chunk: str) -> list[str]:
        """Pieces, in byte characters, of text beyond Latin letters.

        Unicode's tables differ between versions; those of the published library decide how
        such text is normalised and cut. Its encoder is not used.
        """
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.definition)
        normal = self.library.normalizer.normalize_str(chunk)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def encode(self, text: str) -> np.ndarray:
        ids: list[int] = []
        for part in self.splitter.split(text) if "<|" in text else (text,):
            if part in self.special:
                ids.append(self.special[part])
            elif _BEYOND_LATIN.search(part) is None:
                ids += self.latin_ids(part)
            else:
                for chunk in _SPACE.split(part):
                    if _BEYOND_LATIN.search(chunk) is None:
                        ids += self.latin_ids(chunk)
                        continue
                    for piece in self.library_pieces(chunk):
                        ids += self.piece(piece, shown=True)
        return np.array(ids, "<u4")


def token_names(definition: str) -> list[str]:
    """The names of all tokens by id."""
    spec = json.loads(definition)
    ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    return sorted(ids, key=ids.__getitem__)


def _decoded(ids: np.ndarray, names: list[str]) -> str:
    return " ".join([names[i] for i in ids.tolist()])


def _shared(documents: DataFrame, vocabulary: str):
    with open(vocabulary, encoding="utf-8") as file:
        definition = file.read()
    if len(definition) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary of {len(definition)} bytes; at most {MAX_VOCABULARY_BYTES}")
    return documents.sparkSession.sparkContext.broadcast(definition)


def encode(documents: DataFrame, vocabulary: str, decoded: bool = False) -> DataFrame:
    """Token ids of every document's whole text.

    ``documents``: document records (``documentId`` of any type, ``text``); other columns
    are ignored. ``vocabulary``: path of a tokenizer definition that the driver can read.
    Returns documentId, nTokens (long) and tokenIds (binary: little-endian unsigned 32-bit
    ids). Null and empty texts have no tokens; special tokens in a text keep their ids, none
    is added. Rows map to rows: repeated ids and texts stay. With ``decoded``, decodedText
    as ``decode`` makes it is returned too, in the same pass.
    """
    shared = _shared(documents, vocabulary)
    rows = documents.select("documentId", "text")
    out = T.StructType([T.StructField("documentId", rows.schema["documentId"].dataType),
                        T.StructField("nTokens", T.LongType()),
                        T.StructField("tokenIds", T.BinaryType()),
                        *[T.StructField("decodedText", T.StringType())] * decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Tables of the vocabulary live as long as the task: workers are many, and wait long.
        codec = Codec(shared.value)
        names = token_names(shared.value)
        for piece, texts in slices(batches, 1):
            ids = [codec.encode(t or "") for t in texts]
            columns = [piece.column(0), pa.array([len(i) for i in ids], pa.int64()),
                       pa.array([i.tobytes() for i in ids], pa.binary())]
            if decoded:
                columns.append(pa.array([_decoded(i, names) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=out.names)
        del codec, names
        memory_returned()

    return rows.mapInArrow(run, out)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encode``'s rows with decodedText: the names of all tokens, joined by blanks.

    The vocabulary defines no decoder, so word ends stay visible, as in the published
    library. Null ids decode to the empty text.
    """
    shared = _shared(encoded, vocabulary)
    rows = encoded.select("documentId", "nTokens", "tokenIds")
    out = T.StructType([*rows.schema.fields, T.StructField("decodedText", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = token_names(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                texts = [_decoded(np.frombuffer(ids or b"", "<u4"), names)
                         for ids in piece.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(texts, pa.string())], names=out.names)

    return rows.mapInArrow(run, out)
