"""Pages to token rows and the row-level questions asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import markup
from quire.functions.text import BLANK, clean_text, decode_entities
from quire.rules import DEFAULT, HEADER_ENDS, Rules


def token_rows(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, kind, tag, attrs, text), one row per tag or text; narrow, no shuffle.

    ``text`` is decoded and set on text rows only, ``attrs`` on opening and void tags only.
    """
    named = pages.select(key, F.posexplode(markup.tokens(F.col(html))).alias("pos", "token")).withColumn(
        "tag", markup.tag_name("token")
    )
    return (
        named.withColumn("kind", markup.token_kind(F.col("token"), F.col("tag")))
        .filter(F.col("kind") != "skip")
        .select(
            key,
            "pos",
            "kind",
            "tag",
            F.when(F.col("kind").isin("open", "void"), markup.attributes(F.col("token"))).alias("attrs"),
            F.when(F.col("kind") == "text", decode_entities(F.col("token"))).alias("text"),
        )
    )


def tags_with(tokens: DataFrame, tag: str, **wanted: str) -> DataFrame:
    """Opening tags of one name whose attributes have the given values (None: merely present)."""
    found = tokens.filter((F.col("tag") == tag) & F.col("kind").isin("open", "void"))
    for name, value in wanted.items():
        here = F.try_element_at("attrs", F.lit(name))
        found = found.filter(here.isNotNull() if value is None else here == value)
    return found


def first_tag_with(tokens: DataFrame, tag: str, key: str = "page_id", **wanted: str) -> DataFrame:
    """T5: position of the first matching tag per document; partially aggregated before the shuffle."""
    return tags_with(tokens, tag, **wanted).groupBy(key).agg(F.min("pos").alias("pos"))


def first_tags(pages: DataFrame, tags, limit: int, key: str = "page_id", html: str = "html") -> DataFrame:
    """The first ``limit`` opening tags out of ``tags`` per page, cut inside the page's row."""
    wanted = F.filter(
        F.transform(
            markup.tokens(F.col(html)),
            lambda t, i: F.struct(i.alias("pos"), markup.tag_name(t).alias("tag"), t.alias("token")),
        ),
        lambda t: t["tag"].isin(*tags) & ~F.startswith(t["token"], F.lit("</")),
    )
    return pages.select(key, F.posexplode(F.slice(wanted, 1, limit)).alias("n", "t")).select(
        key, (F.col("n") + 1).alias("rank"), "t.pos", "t.tag"
    )


def with_title(
    df: DataFrame, bare: str = "bare", fallback: str | Column = "", rules: Rules = DEFAULT, into: str = "title"
) -> DataFrame:
    """T13 on a skeleton column: <title>, else the first h1/h2, else one of the first five b/strong, else fallback."""
    generic = ["", "untitled", *[n.lower() for n in rules.site_names]]

    def choose(texts: Column, spans: Column) -> Column:
        def of(*tags: str) -> Column:
            return F.filter(spans, lambda s: s["tag"].isin(*tags))

        def text(s: Column) -> Column:
            return clean_text(markup.raw_text(markup.span_text(texts, s)))

        page_title = F.transform(F.slice(of("title"), 1, 1), text)
        headings = F.filter(F.transform(of("h1", "h2"), text), lambda t: F.length(t) > 3)
        bold = F.filter(
            F.transform(F.slice(of("b", "strong"), 1, 5), text), lambda t: (F.length(t) > 5) & (F.length(t) < 200)
        )
        page_title = F.filter(page_title, lambda t: ~F.lower(t).isin(generic))
        return F.coalesce(*[F.get(found, F.lit(0)) for found in (page_title, headings, bold)])

    spans = markup.with_spans(
        df, markup.mark_pattern(["title", "h1", "h2", "b", "strong", *HEADER_ENDS]), bare, strip=False
    )
    otherwise = F.lit(fallback) if isinstance(fallback, str) else fallback
    return markup.without_temporaries(
        spans.withColumn(into, F.coalesce(markup.bound(["__texts", "__spans"], choose), otherwise))
    )


def titles(
    pages: DataFrame, key: str = "page_id", html: str = "html", fallback: str = "", rules: Rules = DEFAULT
) -> DataFrame:
    """(key, title); narrow."""
    bare = pages.select(key, markup.skeleton(F.col(html)).alias("bare"))
    return with_title(bare, fallback=fallback, rules=rules).select(key, "title")


def is_plain_text(html: Column) -> Column:
    """Text whose first visible character is not '<' (an empty document counts as plain text)."""
    return ~html.rlike(rf"^{BLANK}*+<")
