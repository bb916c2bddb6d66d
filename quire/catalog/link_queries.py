"""Queries for links and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog.base import load, query, registry_table, REGISTRY_SQL
from quire.catalog.markup_queries import _ANCHORS
from quire.functions import dates, urls
from quire.operators import links, page_dates
from quire.operators.settle import settled
from quire.rules import DEFAULT

_SKIPPED = ("/the", "/la", "/of", "/der")
LINK_RULES = DEFAULT.but(skip_hrefs=_SKIPPED, link_suffixes=(), external_allow=("example.org/en",))
_SKIP_SQL = "('/the', '/la', '/of', '/der')"
_KEPT = f"SELECT * FROM ({_ANCHORS}) WHERE href NOT IN {_SKIP_SQL} AND href <> '' AND length(trim(text)) >= 3"


def _anchor_rows(spark, sf_dir):
    return load(spark, sf_dir, "pages").transform(links.anchors).transform(settled).select("page_id", F.inline("anchors"))


@query("L1_document_hrefs", f"SELECT page_id, pos, href FROM ({_ANCHORS}) WHERE href <> '' AND href NOT IN {_SKIP_SQL} AND href NOT LIKE '#%'")
def document_hrefs(spark, sf_dir):
    kept = _anchor_rows(spark, sf_dir).filter(links.is_document_href(F.col("href"), LINK_RULES))
    return kept.select("page_id", F.col("pos").cast("bigint").alias("pos"), "href")


@query("L2_allowed_sites", "SELECT page_id, NOT starts_with(url, 'http') OR contains(url, 'example.org/en') AS allowed FROM pages")
def allowed_sites(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    return pages.select("page_id", links.is_allowed_site(F.col("url"), LINK_RULES).alias("allowed"))


@query(
    "L3_document_suffixes",
    "SELECT page_id, split_part(url, '?', 1) LIKE '%.html' OR split_part(url, '?', 1) LIKE '%.txt' AS is_document FROM pages",
)
def document_suffixes(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    return pages.select("page_id", links.has_document_suffix(F.col("url")).alias("is_document"))


@query("L4_link_texts", f"SELECT page_id, pos, text FROM ({_ANCHORS}) WHERE length(trim(text)) >= 3")
def link_texts(spark, sf_dir):
    kept = _anchor_rows(spark, sf_dir).filter(links.has_link_text(F.col("text")))
    return kept.select("page_id", F.col("pos").cast("bigint").alias("pos"), "text")


@query(
    "L5_first_links",
    f"""SELECT page_id, pos, href AS doc_id, trim(text) AS title,
               regexp_extract(url, '^(https?://[^/?#]*)', 1) || href AS url
        FROM (SELECT k.*, p.url, row_number() OVER (PARTITION BY k.page_id, href ORDER BY pos) AS rn
              FROM ({_KEPT}) k JOIN pages p USING (page_id)) WHERE rn = 1""",
)
def first_links(spark, sf_dir):
    found = links.document_links(load(spark, sf_dir, "pages"), base="url", rules=LINK_RULES, with_dates=False)
    return found.select("page_id", "pos", "doc_id", "title", "url")


@query(
    "L6_absolute_urls",
    r"""SELECT page_id, rooted, sibling, queried, marked, up FROM (
          SELECT page_id, site || '/a/b?c#d' AS rooted, folder || 'x.html' AS sibling, base || '?q=1' AS queried,
                 regexp_replace(url, '#.*$', '') || '#s' AS marked,
                 CASE WHEN regexp_matches(folder, '^https?://[^/]*/$') THEN folder
                      ELSE regexp_replace(folder, '[^/]*/$', '') END || 'y' AS up
          FROM (SELECT *, regexp_replace(base, '[^/]*$', '') AS folder
                FROM (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site,
                             regexp_replace(url, '[?#].*$', '') AS base FROM pages)))""",
)
def absolute_urls(spark, sf_dir):
    def against(ref):
        return urls.absolute_url(F.col("url"), F.lit(ref))

    return load(spark, sf_dir, "pages").select(
        "page_id", against("/a/b?c#d").alias("rooted"), against("x.html").alias("sibling"),
        against("?q=1").alias("queried"), against("#s").alias("marked"), against("../y").alias("up"),
    )


@query(
    "L7_document_ids",
    r"""SELECT page_id, regexp_extract(split_part(url, '?', 1), '[^/]*$') AS external_id,
               regexp_replace(url, '^https?://[^/]*/', '') AS relative_id FROM pages""",
)
def document_ids(spark, sf_dir):
    relative = F.regexp_replace("url", F.lit("^https?://[^/]*/"), F.lit(""))
    return load(spark, sf_dir, "pages").select(
        "page_id", urls.document_id(F.col("url")).alias("external_id"), urls.document_id(relative).alias("relative_id")
    )


@query(
    "L8_dates_near_links",
    """SELECT o_orderkey, 0 AS pos, 'o' || o_orderkey || '.html' AS doc_id, 'Order ' || o_orderkey AS title,
              strftime(o_orderdate, '%Y-%m-01') AS date, strftime(o_orderdate, '%B %Y') AS raw_date_str FROM orders
       UNION ALL SELECT o_orderkey, 1, 'y' || o_orderkey || '.html', 'By year', strftime(o_orderdate, '%Y-01-01'),
              strftime(o_orderdate, '%Y') FROM orders
       UNION ALL SELECT o_orderkey, 2, 'n' || o_orderkey || '.txt', 'Without', NULL, '' FROM orders""",
)
def dates_near_links(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    html = F.concat(
        F.lit('<ul><li><a href="o'), key, F.lit('.html">Order '), key, F.lit("</a> of "),
        F.date_format("o_orderdate", "MMMM yyyy"), F.lit('</li><li>In <b>'), F.date_format("o_orderdate", "yyyy"),
        F.lit('</b>: <a href="y'), key, F.lit('.html">By year</a></li><li><a href="n'), key,
        F.lit('.txt">Without</a> a date</li></ul>'),
    )
    pages = load(spark, sf_dir, "orders").select("o_orderkey", html.alias("html"))
    found = links.document_links(pages, "o_orderkey")
    return found.select("o_orderkey", "pos", "doc_id", "title", "date", "raw_date_str")


_RAW = """CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%B %Y') || ', rev. June 2010'
               WHEN 'O' THEN '  written in ' || strftime(o_orderdate, '%Y') || ' ' ELSE o_orderpriority END"""


def _raw_date():
    day, status = F.col("o_orderdate"), F.col("o_orderstatus")
    return (
        F.when(status == "F", F.concat(F.date_format(day, "MMMM yyyy"), F.lit(", rev. June 2010")))
        .when(status == "O", F.concat(F.lit("  written in "), F.date_format(day, "yyyy"), F.lit(" ")))
        .otherwise(F.col("o_orderpriority"))
    )


@query(
    "D1_parsed_dates",
    f"""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-01')
                                              WHEN 'O' THEN strftime(o_orderdate, '%Y-01-01') END AS date,
               trim({_RAW}) AS raw_date_str FROM orders""",
)
def parsed_dates(spark, sf_dir):
    parsed = load(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(_raw_date()).alias("d"))
    return parsed.select("o_orderkey", "d.date", "d.raw_date_str")


@query(
    "D2_page_dates",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-01')
                                              WHEN 'O' THEN strftime(o_orderdate, '%Y-01-01')
                                              ELSE strftime(o_orderdate, '%Y-%m-01') END AS page_date,
              CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%B %Y') || ', rev. May 2011'
                                 WHEN 'O' THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%B %Y') END AS page_raw_date
       FROM orders""",
)
def page_own_dates(spark, sf_dir):
    day, status = F.col("o_orderdate"), F.col("o_orderstatus")
    html = (
        F.when(
            status == "F",
            F.concat(
                F.lit('<p>1999 </p><font size="1">2001<br></font><font face="verdana" size="2">'),
                F.date_format(day, "MMMM yyyy"), F.lit(", rev. May 2011<br><br>Text</font>"),
            ),
        )
        .when(status == "O", F.concat(F.lit("<p>x</p><font size=1>"), F.date_format(day, "yyyy"), F.lit("<br>Text</font>")))
        .otherwise(F.concat(F.lit("<div>None</div><div> "), F.date_format(day, "MMMM yyyy"), F.lit(" began</div>")))
    )
    pages = load(spark, sf_dir, "orders").select("o_orderkey", html.alias("html"))
    return pages.transform(page_dates.with_page_date).select("o_orderkey", "page_date", "page_raw_date")


@query(
    "D3_preferred_dates",
    f"""SELECT doc_id, CASE WHEN read THEN '2020-01-01' ELSE date END AS date,
               CASE WHEN read THEN 'from page' ELSE raw_date_str END AS raw_date_str FROM ({REGISTRY_SQL})""",
)
def preferred_dates(spark, sf_dir):
    known = registry_table(spark, sf_dir).withColumns(
        {"page_date": F.when(F.col("read"), "2020-01-01"), "page_raw_date": F.lit("from page")}
    )
    return known.transform(page_dates.prefer_page_date).select("doc_id", "date", "raw_date_str")


@query(
    "D4_display_dates",
    f"SELECT doc_id, coalesce(nullif(raw_date_str, ''), nullif(date, ''), 'Unknown date') AS shown FROM ({REGISTRY_SQL})",
)
def display_dates(spark, sf_dir):
    shown = dates.display_date(F.col("raw_date_str"), F.col("date"))
    return registry_table(spark, sf_dir).select("doc_id", shown.alias("shown"))
