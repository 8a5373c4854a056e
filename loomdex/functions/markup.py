"""Removing reStructuredText markup from a text column, rule by rule.

Every rule is a Column -> Column function that uses its input once, so the
whole chain stays one linear expression that Catalyst can place anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex import fixed_values as fv
from loomdex.functions.text import (
    is_blank,
    let,
    list_append,
    list_items,
    list_start,
    trimmed,
)


def pattern(template: str, name: str = "") -> str:
    """Fill the white-space classes and the directive name into a fixed pattern."""
    return (
        template.replace("{ws_in_line}", fv.WS_IN_LINE)
        .replace("{ws}", fv.WS)
        .replace("{name}", name)
    )


def _drop(text: Column, template: str, name: str = "") -> Column:
    return F.regexp_replace(text, F.lit(pattern(template, name)), F.lit(""))


def drop_block_directive(text: Column, name: str) -> Column:
    return _drop(text, fv.BLOCK_DIRECTIVE, name)


def drop_known_directives(text: Column) -> Column:
    """Named blocks, single-line directives, include lines and label anchors."""
    for name in fv.BLOCK_DIRECTIVES:  # one pass each: a removal can expose the next
        text = drop_block_directive(text, name)
    for name in fv.LINE_DIRECTIVES:
        text = _drop(text, fv.LINE_DIRECTIVE, name)
    text = _drop(text, fv.INCLUDE_LINE)
    return _drop(text, fv.LABEL_ANCHOR)


def is_decoration(line: Column) -> Column:
    return F.rlike(line, F.lit(pattern(fv.DECORATION)))


def plain_titles(text: Column) -> Column:
    """Keep title texts and drop the decoration lines above and below them."""
    none = F.array().cast("array<string>")

    def convert(lines: Column) -> Column:
        marked = F.transform(
            lines, lambda line: F.struct(line.alias("line"), is_decoration(line).alias("deco"))
        )
        return let(marked, fold)

    def fold(marked: Column) -> Column:
        count = F.size(marked)
        window = F.arrays_zip(
            marked.alias("here"),
            F.slice(marked, F.lit(2), count).alias("next"),
            F.slice(marked, F.lit(3), count).alias("after"),
        )
        start = F.struct(
            *list_start(),
            F.lit(None).cast("string").alias("last"),
            F.lit(0).alias("skip"),
        )
        return F.aggregate(window, start, step, lambda acc: F.array_join(list_items(acc), "\n"))

    def step(acc: Column, at: Column) -> Column:
        line, deco = at["here"]["line"], at["here"]["deco"]
        title = trimmed(at["next"]["line"])
        skipping = acc["skip"] > 0
        framed = deco & F.coalesce(at["after"]["deco"], F.lit(False)) & (title != "")
        underline = (
            deco & ~is_blank(acc["last"]) & ~F.coalesce(is_decoration(acc["last"]), F.lit(False))
        )
        keep = (
            F.when(skipping, none)
            .when(framed, F.array(title))
            .when(underline, none)
            .otherwise(F.array(line))
        )
        last = (
            F.when(skipping, acc["last"])
            .when(framed, title)
            .when(underline, acc["last"])
            .otherwise(line)
        )
        skip = F.when(skipping, acc["skip"] - 1).when(framed, 2).otherwise(0)
        return F.struct(*list_append(acc, keep), last.alias("last"), skip.alias("skip"))

    decorated = F.rlike(text, F.lit("(?m)" + pattern(fv.DECORATION)))
    return F.when(decorated, let(F.split(text, "\n", -1), convert)).otherwise(text)


def open_code_blocks(text: Column) -> Column:
    """Turn a code-block directive line into a blank line; the body stays."""
    return F.regexp_replace(text, F.lit(pattern(fv.CODE_BLOCK_LINE)), F.lit("\n"))


def strip_inline_markup(text: Column) -> Column:
    """Roles and inline code keep their label; substitutions are dropped."""
    for template in (fv.ROLE_WITH_TARGET, fv.ROLE, fv.INLINE_CODE):
        text = F.regexp_replace(text, F.lit(pattern(template)), F.lit("$1"))
    for template in (fv.PIPE_SUBSTITUTION, fv.BRACE_SUBSTITUTION):
        text = _drop(text, template)
    return text


def drop_remaining_directives(text: Column) -> Column:
    """Whatever directive, orphan line or comment the named rules left over."""
    for template in (
        fv.ANY_BLOCK_DIRECTIVE,
        fv.INDENTED_DIRECTIVE_LINE,
        fv.BULLET_INCLUDE,
        fv.COMMENT_LINE,
        fv.ANY_BLOCK_DIRECTIVE,
    ):
        text = _drop(text, template)
    return text


def collapse_space(text: Column) -> Column:
    """Remove deep indentation, runs of blank lines and outer white space."""
    text = _drop(text, fv.DEEP_INDENT)
    text = F.regexp_replace(text, F.lit(fv.BLANK_RUN), F.lit("\n\n"))
    return trimmed(text)


def clean_markup(text: Column) -> Column:
    """All cleaning rules in their fixed order.

    Directive rules need a ".." in the text; texts without one skip those passes.
    """

    def with_dots(rule):
        return lambda t: F.when(F.contains(t, F.lit("..")), rule(t)).otherwise(t)

    def inline(t: Column) -> Column:
        return strip_inline_markup(open_code_blocks(t))

    cleaned = let(text, with_dots(drop_known_directives))
    cleaned = let(cleaned, plain_titles)
    cleaned = let(inline(cleaned), with_dots(drop_remaining_directives))
    return collapse_space(cleaned)


def first_line_title(text: Column, fallback: Column) -> Column:
    """First non-blank line, trimmed, or the fallback."""
    not_space = "[^" + fv.WS[1:]
    found = F.regexp_extract(text, rf"([^\n]*{not_space}[^\n]*)", 1)
    return F.coalesce(F.nullif(trimmed(found), F.lit("")), fallback)
