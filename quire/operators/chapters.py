"""Chapters and ordered collections."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import markup, urls
from quire.functions.dates import display_date
from quire.functions.text import escape_html, py_strip
from quire.operators.content import content_length
from quire.operators.ranking import Key, numbered
from quire.operators.settle import settled
from quire.rules import DATE_CLASS, DEFAULT, ORDERS, STYLESHEET, TOC_SECTION, Rules


def has_enough_content(content_html: Column, rules: Rules = DEFAULT) -> Column:
    """C1"""
    return content_length(markup.strip_wrappers(content_html)) >= rules.min_chapter


def chapter_html(title: Column, content_html: Column, date: Column) -> Column:
    """The chapter page; the date line only where there is a date."""
    heading = escape_html(title)
    date_line = F.concat(F.lit(f'<p class="{DATE_CLASS}">'), escape_html(F.nullif(date, F.lit(""))), F.lit("</p>"))
    body = F.when(py_strip(content_html) != "", content_html).otherwise("<p>Content not available.</p>")
    return F.concat_ws(
        "\n",
        F.lit('<html xmlns="http://www.w3.org/1999/xhtml">'),
        F.lit("<head>"),
        F.concat(F.lit("<title>"), heading, F.lit("</title>")),
        F.lit(f'<link rel="stylesheet" type="text/css" href="{STYLESHEET}"/>'),
        F.lit("</head>"),
        F.lit("<body>"),
        F.concat(F.lit("<h1>"), heading, F.lit("</h1>")),
        date_line,
        body,
        F.lit("</body>"),
        F.lit("</html>"),
    )


def has_body(html: Column) -> Column:
    """C4: the page has a body with visible text."""
    body = F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)", 1)
    return markup.node_text(markup.skeleton(body)) != ""


def chapter_title(title: Column, raw: Column, date: Column) -> Column:
    """Title with the raw date, else the ISO date, in brackets; just the title without either."""
    shown = display_date(raw, date, unknown=None)
    return F.concat(title, F.coalesce(F.concat(F.lit(" ("), shown, F.lit(")")), F.lit("")))


def check_order(order: str) -> str:
    """C11"""
    if order not in ORDERS:
        raise ValueError(f"order must be one of {', '.join(ORDERS)}; got {order!r}")
    return order


def _undated() -> Column:
    return F.nullif(F.col("date"), F.lit("")).isNull()


def collection_keys(order: str = "desc") -> list[Key]:
    """Dated documents by (date, title) one way or the other, undated ones always last by ascending title; unread
    before read on full ties."""
    check_order(order)
    date, dated_title = F.nullif(F.col("date"), F.lit("")), F.when(~_undated(), F.col("title"))
    down = order == "desc"
    return [Key(_undated()), Key(date, down), Key(dated_title, down), *map(Key, (F.col("title"), F.col("read"), F.col("first_pos")))]


def collection_order(order: str = "desc") -> list[Column]:
    """C7 as sort columns."""
    return [k.column() for k in collection_keys(order)]


def reversible_keys(order: str = "desc") -> list[Key]:
    """The whole key reversed in descending order, so undated documents come first there."""
    check_order(order)
    down = order == "desc"
    key = F.coalesce(F.nullif(F.col("date"), F.lit("")), F.col("title"))
    return [Key(_undated(), down), Key(key, down), Key(F.col("read")), Key(F.col("first_pos"))]


def reversible_order(order: str = "desc") -> list[Column]:
    """C8 as sort columns."""
    return [k.column() for k in reversible_keys(order)]


def build_chapters(docs: DataFrame, rules: Rules = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents with ``content_html`` to chapters; thin ones are dropped. Narrow.

    Stored content carries its text length as ``n_chars``; the gate is then a filter the Parquet scan applies, and a
    caller that needs only the keys never reads the text. Without the column the length is measured here. A chapter with
    a character of content has a visible body, so C4 is only looked at where the gate lets empty content through.

    Keeps doc_id, title, date, raw_date_str, read, first_pos and the columns named in ``keep``, and adds chapter_id,
    chapter_title, html.
    """
    docs = docs.withColumn("content_html", markup.strip_wrappers(F.col("content_html")))
    if "n_chars" not in docs.columns:
        docs = settled(docs.withColumn("n_chars", content_length(F.col("content_html"))))
    kept = docs.filter(F.col("n_chars") >= rules.min_chapter)
    shown = display_date(F.col("raw_date_str"), F.col("date"), unknown=None)
    made = kept.select(
        "doc_id",
        "title",
        "date",
        "raw_date_str",
        "read",
        "first_pos",
        *keep,
        urls.chapter_id(F.col("doc_id")).alias("chapter_id"),
        chapter_title(F.col("title"), F.col("raw_date_str"), F.col("date")).alias("chapter_title"),
        chapter_html(F.col("title"), F.col("content_html"), shown).alias("html"),
    )
    return made if rules.min_chapter > 0 else settled(made).filter(has_body(F.col("html")))


def clashing_keys(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """File-safe keys that more than one document maps to."""
    keys = docs.select(F.col(doc_id).alias("doc_id"), urls.safe_key(F.col(doc_id)).alias("safe_key"))
    return keys.groupBy("safe_key").agg(F.count_distinct("doc_id").alias("n_docs")).filter("n_docs > 1")


def spine(
    chapters: DataFrame, collection: str = "collection", order: str = "desc", exact_parallel: bool | None = None
) -> DataFrame:
    """(collection, ordinal, doc_id): the reading order, counted from 1 in each collection.

    Only the sort keys travel, never the chapter text. See ``ranking.numbered`` for how one huge collection is spread.
    """
    keys = chapters.select(collection, "doc_id", "date", "title", "read", "first_pos")
    ranked = numbered(keys, [F.col(collection)], collection_keys(order), "ordinal", exact_parallel)
    return ranked.select(collection, "ordinal", "doc_id")


def spine_items(spine_rows: DataFrame, collection: str = "collection", cover: bool = False) -> DataFrame:
    """The full spine: the cover if any, the navigation page, then the chapters."""
    fixed = (["cover"] if cover else []) + ["nav"]
    starts = spine_rows.select(collection).distinct().select(
        collection,
        F.posexplode(F.array(*[F.lit(i) for i in fixed])).alias("position", "item"),
    )
    chapters = spine_rows.select(
        collection, (F.col("ordinal") + len(fixed) - 1).alias("position"), urls.chapter_id(F.col("doc_id")).alias("item")
    )
    return starts.select(collection, F.col("position").cast("bigint").alias("position"), "item").unionByName(chapters)


def toc(chapters: DataFrame, spine_rows: DataFrame, collection: str = "collection") -> DataFrame:
    """Table of contents, one row per chapter in one section."""
    names = chapters.select(collection, "doc_id", "chapter_title", "chapter_id")
    return spine_rows.join(names, [collection, "doc_id"]).select(
        collection,
        F.lit(TOC_SECTION).alias("section"),
        "ordinal",
        F.col("chapter_title").alias("title"),
        F.concat("chapter_id", F.lit(".xhtml")).alias("file_name"),
    )


def with_metadata(
    collections: DataFrame, run_date: dt.date, rules: Rules = DEFAULT, custom_title: str | None = None
) -> DataFrame:
    """Adds the descriptive columns of a collection; the run date is an argument so that reruns agree."""
    return collections.withColumns(
        {
            "identifier": F.lit(f"{rules.identifier_prefix}-{run_date:%Y%m%d}"),
            "title": F.lit(custom_title or f"{rules.collection_title} - {run_date:%Y-%m-%d}"),
            "language": F.lit(rules.language),
            "author": F.lit(rules.author),
            "publisher": F.lit(rules.publisher),
        }
    )
