"""Which part of a page is the document: navigation, main region, lone links, headers.

Every operator rewrites a skeleton column. Spans come from ``markup.elements``, so all of it happens in the page's own
row: no shuffle, no join, and no group larger than the page already is. Columns starting with ``__`` are temporary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import markup
from quire.functions.arrays import (
    contains_any,
    count_contained,
    let,
    outermost,
    replace_ranges,
    strings,
)
from quire.functions.spans import lone_links
from quire.functions.text import py_strip
from quire.operators.settle import settled
from quire.rules import DEFAULT, HEADER_ENDS, VOID_TAGS, Rules


def _cut_out(names: Column, texts: Column, spans: Column) -> Column:
    """The skeleton without the given spans (sorted, disjoint); the texts around each stay separate nodes."""
    ranges = F.transform(
        spans,
        lambda s: F.struct((s["open"] * 2 + 1).alias("from"), (_last_mark(names, s) * 2 + 2).alias("to")),
    )
    return replace_ranges(markup.pieces_of(names, texts), ranges, markup.BREAK)


def _last_mark(names: Column, span: Column) -> Column:
    """A span's own closing mark if it has one, else the mark before the one that ended it."""
    own = F.get(names, span["close"]) == F.concat(F.lit("/"), span["tag"])
    return span["close"] - F.when(own, 0).otherwise(1)


def with_navigation_spans(df: DataFrame, bare: str = "bare", rules: Rules = DEFAULT) -> DataFrame:
    """B1/B2: adds ``__spans``: navigation tables, being short with several keywords in the text, or holding several
    links whose text *is* a keyword."""
    words = strings(rules.nav_keywords)

    def choose(low: Column, spans: Column) -> Column:
        return F.filter(
            spans,
            lambda s: s["tag"].isin(*rules.nav_tags)
            & (
                F.when(
                    s["len"] < rules.nav_text_below,
                    count_contained(markup.span_text(low, s), rules.nav_keywords) >= rules.nav_min_hits,
                ).otherwise(False)
                | ((s["links"] >= rules.nav_min_links) & (s["hits"] >= rules.nav_min_hits))
            ),
        )

    marked = markup.with_marks(df, markup.mark_pattern([*rules.nav_tags, "a"]), bare)
    marked = marked.withColumn("__low", F.transform("__texts", lambda t: F.lower(markup.node_text(t))))
    marked = marked.withColumn(
        "__hits",
        F.zip_with(
            "__names",
            F.slice("__low", F.lit(2), F.size("__low")),
            lambda name, label: F.when((name == "a") & F.array_contains(words, label), 1).otherwise(0),
        ),
    )
    marked = markup.with_elements(
        marked, F.col("__names"), F.transform("__low", F.length), "a", F.col("__hits"), "__all"
    )
    return marked.withColumn("__spans", markup.bound(["__low", "__all"], choose))


def remove_navigation(df: DataFrame, bare: str = "bare", rules: Rules = DEFAULT) -> DataFrame:
    """B1/B2: the skeleton column without its navigation tables."""
    found = with_navigation_spans(df, bare, rules)
    found = found.withColumn("__gone", outermost(F.col("__spans")))
    return markup.without_temporaries(
        found.withColumn(bare, markup.bound(["__names", "__texts", "__gone"], _cut_out))
    )


def is_navigation_image(src: Column, alt: Column, rules: Rules = DEFAULT) -> Column:
    """A keyword anywhere in the image's address or alternative text."""
    return contains_any(F.lower(F.coalesce(src, F.lit(""))), rules.nav_keywords) | contains_any(
        F.lower(F.coalesce(alt, F.lit(""))), rules.nav_keywords
    )


def main_region(df: DataFrame, bare: str = "bare", rules: Rules = DEFAULT) -> DataFrame:
    """The skeleton of the region tag with most text, else of the body, else of everything but the head."""

    def largest(names: Column, texts: Column, spans: Column) -> Column:
        big = F.filter(spans, lambda s: s["len"] > rules.region_text_above)
        ranked = F.transform(
            big,
            lambda s: F.struct(
                s["len"].alias("len"), (-s["open"]).alias("first"),
                (_last_mark(names, s) - s["open"]).alias("marks"),
            ),
        )
        return let(
            F.array_max(ranked),
            lambda best: F.when(
                best.isNotNull(),
                F.array_join(
                    F.slice(markup.pieces_of(names, texts), 2 - best["first"] * 2, best["marks"] * 2 + 1), ""
                ),
            ),
        )

    page = F.col(bare)
    body = F.regexp_replace(page, F.lit(r"(?is)^.*?(?=\x01body\x02)|(?<=\x01/body\x02).*$"), F.lit(""))
    headless = F.regexp_replace(
        page, F.lit(r"(?is)\x01head\x02.*?\x01/head\x02|\x01title\x02.*?\x01/title\x02"), F.lit("")
    )
    spans = markup.with_spans(df, markup.mark_pattern(rules.region_tags), bare)
    region = markup.bound(["__names", "__texts", "__spans"], largest)
    return markup.without_temporaries(
        spans.withColumn("__region", region).withColumn(
            bare,
            F.coalesce("__region", F.when(page.rlike(r"(?i)\x01body\x02"), body).otherwise(headless)),
        )
    )


def with_lone_link_spans(df: DataFrame, bare: str = "bare", rules: Rules = DEFAULT) -> DataFrame:
    """Adds ``__gone``: spans of links that stand alone, in document order.

    B7 looks at the neighbours as they are in the page: nothing, blank text or another link on both sides. B6 compares
    a link with what is left of its direct parent's text after earlier removals (see ``spans.lone_links``).
    """
    def alone(names: Column, texts: Column, e: Column) -> Column:
        def blank_or(text: Column, edge: Column) -> Column:
            return F.when(text == "", edge).otherwise(py_strip(text) == "")

        before, ended_by = F.get(names, e["open"] - 1), F.get(names, e["close"])
        closed = F.coalesce(ended_by == "/a", F.lit(False))
        after = F.when(closed, F.get(names, e["close"] + 1)).otherwise(ended_by)
        text_after = F.when(closed, F.get(texts, e["close"] + 1)).otherwise(F.lit(""))
        first = before.isNull() | (before == "/a") | (
            ~F.startswith(before, F.lit("/")) & (before != "") & ~before.isin(*VOID_TAGS)
        )
        last = after.isNull() | (after == "a") | (F.startswith(after, F.lit("/")) & (after != "/a"))
        return blank_or(F.get(texts, e["open"]), first) & blank_or(text_after, last)

    # Pages without a link have nothing to judge; leave their tags unparsed.
    linked = df.withColumn("__linked", F.when(F.col(bare).rlike(markup.mark_pattern(["a"])), F.col(bare)))
    spans = markup.with_spans(linked, markup.MARK, "__linked")
    judged = spans.withColumn(
        "__judged",
        markup.bound(
            ["__names", "__texts", "__spans"],
            lambda names, texts, elements: F.transform(
                elements,
                lambda e: F.struct(
                    e["open"].alias("open"), e["close"].alias("close"), e["tag"].alias("tag"), e["len"].alias("len"),
                    ((e["tag"] == "a") & (e["len"] < rules.lone_link_below)).alias("short"),
                    F.when(e["tag"] == "a", F.coalesce(alone(names, texts, e), F.lit(False)))
                    .otherwise(F.lit(False))
                    .alias("alone"),
                ),
            ),
        ),
    )
    return settled(judged.withColumn("__gone", lone_links(F.col("__judged"), rules.link_containers, rules.lone_link_slack)))


def remove_lone_links(df: DataFrame, bare: str = "bare", rules: Rules = DEFAULT) -> DataFrame:
    """The skeleton column without its stand-alone links."""
    found = with_lone_link_spans(df, bare, rules)
    return markup.without_temporaries(
        found.withColumn(
            bare,
            F.when(F.size("__gone") > 0, markup.bound(["__names", "__texts", "__gone"], _cut_out)).otherwise(
                F.col(bare)
            ),
        )
    )


def break_headers(df: DataFrame, bare: str = "bare", rules: Rules = DEFAULT) -> DataFrame:
    """Short bold passages become paragraphs of their own."""
    low, high = rules.header_between
    note = markup.BREAK + "\n\n" + markup.BREAK

    def insert(names: Column, texts: Column, spans: Column) -> Column:
        points = F.flatten(
            F.transform(
                F.filter(
                    spans, lambda s: s["tag"].isin(*rules.header_tags) & (s["len"] > low) & (s["len"] < high)
                ),
                lambda s: F.array(s["open"] * 2 + 1, _last_mark(names, s) * 2 + 2),
            )
        )
        ranges = F.transform(F.sort_array(points), lambda p: F.struct(p.alias("from"), p.alias("to")))
        return replace_ranges(markup.pieces_of(names, texts), ranges, note)

    # Block elements end a header that was never closed.
    spans = markup.with_spans(df, markup.mark_pattern([*rules.header_tags, *HEADER_ENDS]), bare)
    return markup.without_temporaries(
        spans.withColumn(bare, markup.bound(["__names", "__texts", "__spans"], insert))
    )


def skeletons(pages: DataFrame, html: str = "html", bare: str = "bare") -> DataFrame:
    """Replace the markup column by its skeleton; narrow."""
    return pages.withColumn(bare, markup.skeleton(F.col(html))).drop(html)
