"""Paragraph rules over an array<string> column, and plain-text blocks (P1-P11). All narrow."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.arrays import contains_any, let
from quire.functions.dates import DATE_LINE
from quire.functions.text import BLANK, NON_BLANK, escape_body_text, escape_html, py_strip
from quire.rules import CONTENT_CLASS, DEFAULT, Rules

# A word of two or more characters that starts with a letter which is not upper case.
_LOWER_START = rf"(?:^|{BLANK})[\p{{L}}&&[^\p{{Lu}}]]{NON_BLANK}"


def split_paragraphs(text: Column, rules: Rules = DEFAULT) -> Column:
    """Blank lines separate paragraphs; blanks inside collapse, single newlines stay, short ones go."""
    blocks = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), rf"\n{BLANK}*\n", -1)
    # A single space is left alone instead of being replaced by itself.
    return F.filter(
        F.transform(blocks, lambda p: F.regexp_replace(py_strip(p), F.lit(r"[ \t]{2,}|\t"), F.lit(" "))),
        lambda p: F.length(p) > rules.min_paragraph,
    )


# The predicates take the lower-cased paragraph as ``low`` where the caller has it at hand.


def _has_phrase(low: Column, phrases, rules: Rules) -> Column:
    if rules.keyword_match == "word":
        return low.rlike(r"(?<!\w)(?:" + "|".join(re.escape(p) for p in phrases) + r")(?!\w)")
    return contains_any(low, phrases)


def is_related_marker(p: Column, rules: Rules = DEFAULT) -> Column:
    """P2"""
    return let(F.lower(p), lambda low: contains_any(low, rules.related_markers))


def is_title(p: Column, title: Column, low: Column | None = None) -> Column:
    """P3"""
    return (F.lower(p) if low is None else low) == F.lower(py_strip(F.coalesce(title, F.lit(""))))


def is_navigation(p: Column, rules: Rules = DEFAULT, low: Column | None = None) -> Column:
    """P4"""
    short = F.length(p) < rules.nav_phrase_below
    return short & _has_phrase(F.lower(p) if low is None else low, rules.nav_phrases, rules)


def is_ad(p: Column, rules: Rules = DEFAULT, low: Column | None = None) -> Column:
    """P5"""
    short = F.length(p) < rules.ad_phrase_below
    return short & _has_phrase(F.lower(p) if low is None else low, rules.ad_phrases, rules)


def is_lone_mark(p: Column, rules: Rules = DEFAULT) -> Column:
    """Matters only where the minimum paragraph length was lowered."""
    return p.isin(*rules.lone_marks)


def is_link_title(p: Column, rules: Rules = DEFAULT, low: Column | None = None) -> Column:
    """P7"""
    spaces = F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit("")))
    return (
        (F.length(p) < rules.link_title_below)
        & F.contains(p, F.lit(":"))
        & (spaces < rules.link_title_spaces)
        & contains_any(F.lower(p) if low is None else low, rules.link_title_hints)
    )


def is_date_line(p: Column) -> Column:
    """P8"""
    return p.rlike(DATE_LINE)


def before_related(paragraphs: Column, rules: Rules = DEFAULT) -> Column:
    """What precedes the first paragraph with a related-links marker."""
    at = F.array_position(F.transform(paragraphs, lambda p: is_related_marker(p, rules)), True)
    return F.when(at > 0, F.slice(paragraphs, F.lit(1), (at - 1).cast("int"))).otherwise(paragraphs)


def is_trailing_noise(p: Column) -> Column:
    """Short text that reads like a title or a fragment. Longer or finished text ends the trim."""
    ends = F.endswith(p, F.lit("."))
    real = (F.length(p) > 60) | (ends & (F.length(p) > 30))
    title_like = (F.regexp_count(p, F.lit(rf"{NON_BLANK}+")) < 6) & (F.length(p) < 50) & ~p.rlike(_LOWER_START)
    return ~real & (title_like | ((F.length(p) < 40) & ~ends))


def trim_tail(paragraphs: Column) -> Column:
    """Drop trailing noise up to the last real paragraph."""
    return let(
        paragraphs,
        lambda all_p: let(
            F.array_position(F.reverse(F.transform(all_p, is_trailing_noise)), False),
            lambda back: F.slice(
                all_p,
                F.lit(1),
                F.when(back > 0, F.size(all_p) - back.cast("int") + 1).otherwise(F.lit(0)),
            ),
        ),
    )


def keep_content(paragraphs: Column, title: Column, rules: Rules = DEFAULT) -> Column:
    """Cut at the related-links marker, then drop titles, navigation, ads, link titles and date lines."""

    def dropped(p: Column, low: Column, title_low: Column) -> Column:
        return (
            (low == title_low)
            | is_navigation(p, rules, low)
            | is_ad(p, rules, low)
            | is_lone_mark(p, rules)
            | is_link_title(p, rules, low)
            | is_date_line(p)
        )

    title_low = F.lower(py_strip(F.coalesce(title, F.lit(""))))
    return let(
        title_low,
        lambda t: F.filter(
            let(paragraphs, lambda all_p: before_related(all_p, rules)),
            lambda p: ~let(F.lower(p), lambda low: dropped(p, low, t)),
        ),
    )


def wrap_paragraphs(paragraphs: Column, css_class: str = CONTENT_CLASS) -> Column:
    """P10: the content container with one <p> per paragraph."""
    body = F.array_join(
        F.transform(paragraphs, lambda p: F.concat(F.lit("<p>"), escape_body_text(p), F.lit("</p>"))), ""
    )
    return F.concat(F.lit(f'<div class="{css_class}">'), body, F.lit("</div>"))


def line_kind(line: Column) -> Column:
    """P11: 'code', 'blank' or 'text'."""
    code = F.startswith(line, F.lit("  ")) & (
        F.contains(line, F.lit(";")) | F.contains(line, F.lit("(")) | F.contains(F.lower(line), F.lit("def"))
    )
    return F.when(code, "code").when(py_strip(line) == "", "blank").otherwise("text")


def plain_text_blocks(text: Column) -> Column:
    """Maximal runs of code or text lines as array<struct<kind,lines>>."""
    return let(
        F.split(text, "\n", -1),
        lambda lines: let(
            F.transform(lines, line_kind),
            lambda kinds: let(
                F.filter(
                    F.sequence(F.lit(0), F.size(kinds) - 1),
                    lambda i: (i == 0) | (F.get(kinds, i) != F.get(kinds, i - 1)),
                ),
                lambda starts: F.filter(
                    F.transform(
                        starts,
                        lambda s, k: F.struct(
                            F.get(kinds, s).alias("kind"),
                            F.slice(lines, s + 1, F.coalesce(F.get(starts, k + 1), F.size(lines)) - s).alias("lines"),
                        ),
                    ),
                    lambda b: b["kind"] != "blank",
                ),
            ),
        ),
    )


def plain_text_to_html(text: Column, rules: Rules = DEFAULT, css_class: str = CONTENT_CLASS) -> Column:
    """Plain text as the content container; ``compat`` spaces code lines by three newlines."""
    before, between, after = ("\n", "\n\n\n", "\n\n\n") if rules.compat else ("", "\n", "")

    def block(b: Column) -> Column:
        code = F.concat(
            F.lit("<pre><code>" + before),
            F.array_join(F.transform(b["lines"], escape_html), between),
            F.lit(after + "</code></pre>"),
        )
        prose = F.concat(
            F.lit("<p>"),
            F.array_join(F.transform(b["lines"], lambda line: escape_html(py_strip(line))), " "),
            F.lit("</p>"),
        )
        return F.when(b["kind"] == "code", code).otherwise(prose)

    return F.array_join(
        F.concat(
            F.array(F.lit(f'<div class="{css_class}">')),
            F.transform(plain_text_blocks(text), block),
            F.array(F.lit("</div>")),
        ),
        "\n",
    )
