import pytest
from pyspark.sql import functions as F

from loomdex.functions import markup
from loomdex.operators.corpus import clean_corpus, parse_rejects, parse_report, parsed_documents


def run(spark, rule, text):
    return spark.createDataFrame([(text,)], "t string").select(rule(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        (".. meta::\n   :k: v\n\nkept\n", "kept\n"),
        (".. contents:: On this page\n   :local:\nkept\n", "kept\n"),
        ("a\n\n.. figure:: x.png\n\n   caption\n\n   more\nb\n", "a\n\nb\n"),
        # one removal exposes the next
        (".. tabbed::\n.. tab::\n   x\ny\n", "y\n"),
        (".. default-domain:: x\n   kept\n", "   kept\n"),
        ("  .. include:: /a.rst\nb\n", "b\n"),
        (".. _some-label:\n\nb\n", "b\n"),
        (".. other::\n   body\n", ".. other::\n   body\n"),
        # the last line needs a line break to be a directive line
        ("x\n.. meta:: y", "x\n.. meta:: y"),
    ],
)
def test_known_directives(spark, text, expected):
    assert run(spark, markup.drop_known_directives, text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("====\n Title \n====\nbody", "Title\nbody"),
        ("Title\n-----\nbody", "Title\nbody"),
        ("Title\n-----\n-----\nbody", "Title\nbody"),
        ("a\n==\nb", "a\n==\nb"),              # two characters are no decoration
        ("\n----\nb", "\n----\nb"),            # nothing above to underline
        ("----\na\nb", "----\na\nb"),          # no closing line
        ("===\n\n===\nb", "===\n\n===\nb"),    # a blank title is none
        ("T\n===\nA\n---\n", "T\n---\n"[:2] + "A\n"),
        ("plain text", "plain text"),
        ("====\nA\n====\nB\n----", "A\nB"),
    ],
)
def test_titles(spark, text, expected):
    if text == "T\n===\nA\n---\n":
        # the first underline, "A" and the second form a framed title as well
        expected = "T\nA\n"
    assert run(spark, markup.plain_titles, text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        (":ref:`the label <target>`", "the label"),
        (":doc:`/path/page`", "/path/page"),
        ("``code``", "code"),
        ("a |sub| b", "a  b"),
        ("a {+name+} b", "a  b"),
        ("a {+two words+} b", "a  b"),
        ("`plain`", "`plain`"),
        ("1 | 2 | 3", "1 | 2 | 3"),
    ],
)
def test_inline(spark, text, expected):
    assert run(spark, markup.strip_inline_markup, text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        (".. tip::\n   body\n\nkept\n", "kept\n"),
        ("   .. selected-content::\nkept\n", "kept\n"),
        ("  - .. include:: /x\nkept\n", "kept\n"),
        (".. a comment\nkept\n", "kept\n"),
        (".. TODO: later\nkept\n", "kept\n"),
        ("1.. no\n", "1.. no\n"),
    ],
)
def test_remaining_directives(spark, text, expected):
    assert run(spark, markup.drop_remaining_directives, text) == expected


def test_space(spark):
    assert run(spark, markup.collapse_space, "\n\n a\n   b\n\n\n\n  c \n") == "a\nb\n\n  c"


def test_code_block_keeps_its_body(spark):
    assert run(spark, markup.open_code_blocks, ".. code-block:: js\n   x()\n") == "\n   x()\n"


def test_whole_chain(spark):
    raw = (
        "====\nTitle\n====\n\n.. meta::\n   :k: v\n\nSub\n---\n\nSee :ref:`the page <x>` and "
        "``code`` |sub|.\n\n.. note::\n   hidden\n\n     deep\n.. comment\n\n\n\n"
        ".. code-block:: js\n\n   db.x()\n"
    )
    assert run(spark, markup.clean_markup, raw) == "Title\n\nSub\n\nSee the page and code .\n\ndb.x()"


def test_huge_directive_block_does_not_overflow(spark):
    block = ".. meta::\n" + "   line\n" * 200_000
    assert run(spark, markup.clean_markup, "a\n" + block + "b\n") == "a\nb"


def test_many_titles(spark):
    text = "".join(f"T{i}\n====\n" for i in range(20_000))
    assert run(spark, markup.plain_titles, text) == "".join(f"T{i}\n" for i in range(20_000))


def test_corpus_job(spark):
    raw = spark.createDataFrame(
        [("a", "T\n===\nbody"), ("b", ".. note::\n   x\n"), ("c", "unknown")], "id string, text string"
    )
    manifest = spark.createDataFrame(
        [("a", "A", "src", "u", "a.txt", "cat"), ("b", "B", "src", "u", "b.txt", "cat")],
        "id string, title string, source string, sourceUrl string, file string, category string",
    )
    cleaned = clean_corpus(raw, manifest)
    docs = parsed_documents(cleaned).collect()
    assert [(d.documentId, d.title, d.extractedTitle, d.text) for d in docs] == [
        ("a", "A", "T", "T\nbody")
    ]
    assert {(r.file, r.reason) for r in parse_rejects(cleaned).collect()} == {
        ("b.txt", "empty after cleaning"), ("c.txt", "no manifest entry")
    }
    report = parse_report(cleaned).first()
    assert (report.raw, report.processed, report.failed, report.short, report.enough) == (
        3, 1, 2, 1, False
    )


def test_long_open_brace_does_not_overflow(spark):
    from loomdex.functions.markup import strip_inline_markup

    text = "{+a" + "b " * 100_000
    rows = spark.createDataFrame([(text,), ("x {+name of it+} y",)], "text string")
    out = [r[0] for r in rows.select(strip_inline_markup(F.col("text"))).collect()]
    assert out[0] == text and "{+" not in out[1]
