"""Index pages to document links (L1-L8, SRC2). Everything happens inside the index page's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import markup, urls
from quire.functions.arrays import contains_any, let
from quire.functions.dates import iso_date, nearby_date
from quire.rules import DEFAULT, Rules


def is_document_href(href: Column, rules: Rules = DEFAULT) -> Column:
    """L1: not empty, not one of the site's own pages (compared with the query string), not a fragment."""
    return (
        href.isNotNull() & (href != "") & ~href.isin(*rules.skip_hrefs) & ~F.startswith(href, F.lit("#"))
    )


def is_allowed_site(href: Column, rules: Rules = DEFAULT) -> Column:
    """L2: relative, or external with one of the allowed parts in the address."""
    return ~urls.is_external(href) | contains_any(href, rules.external_allow)


def has_document_suffix(href: Column, rules: Rules = DEFAULT) -> Column:
    """L3: the part before '?' ends in a document suffix; no suffixes configured means any."""
    if not rules.link_suffixes:
        return F.lit(True)
    out = F.lit(False)
    for suffix in rules.link_suffixes:
        out = out | F.endswith(urls.before_query(href), F.lit(suffix))
    return out


def has_link_text(text: Column, rules: Rules = DEFAULT) -> Column:
    """L4"""
    return F.length(text) >= rules.min_link_text


def keep_link(href: Column, text: Column, rules: Rules = DEFAULT) -> Column:
    """L1-L4"""
    return (
        is_document_href(href, rules)
        & is_allowed_site(href, rules)
        & has_document_suffix(href, rules)
        & has_link_text(text, rules)
    )


def anchors(df: DataFrame, html: str = "html", with_dates: bool = False) -> DataFrame:
    """SRC2/T6: adds ``anchors``: array<struct<pos,href,text[,raw_date]>> of all <a href>, in document order.

    ``raw_date`` (L8) is searched in the text of the link's parent element, once per parent.
    """
    pattern = markup.MARK if with_dates else markup.mark_pattern(["a"])
    hrefs = F.transform(
        F.filter(markup.tokens(F.col(html)), lambda t: t.rlike(r"(?i)^<a[\s/>]")),
        lambda t: markup.attribute(t, "href"),
    )
    bare = df.withColumns({"__bare": markup.skeleton(F.col(html)), "__hrefs": hrefs})
    spans = markup.with_spans(bare, pattern, "__bare", strip=False)

    def collect(texts: Column, elements: Column, links: Column, dates: Column | None) -> Column:
        def anchor(a: Column, i: Column) -> Column:
            fields = [
                i.alias("pos"),
                F.get(links, i).alias("href"),
                markup.span_nodes(texts, a).alias("text"),
            ]
            if dates is not None:
                fields.append(F.try_element_at(dates, a["parent"]).alias("raw_date"))
            return F.struct(*fields)

        found = F.transform(F.filter(elements, lambda e: e["tag"] == "a"), anchor)
        return F.filter(found, lambda a: a["href"].isNotNull())

    if not with_dates:
        made = markup.bound(
            ["__texts", "__spans", "__hrefs"], lambda texts, elements, links: collect(texts, elements, links, None)
        )
        return markup.without_temporaries(spans.withColumn("anchors", made))

    def parent_dates(texts: Column, elements: Column) -> Column:
        parents = F.array_distinct(
            F.transform(F.filter(elements, lambda e: e["tag"] == "a"), lambda e: e["parent"])
        )
        return F.map_from_arrays(
            parents,
            F.transform(
                parents,
                lambda p: nearby_date(
                    F.when(p >= 0, markup.span_text(texts, F.get(elements, p))).otherwise(F.array_join(texts, ""))
                ),
            ),
        )

    dated = spans.withColumn("__dates", markup.bound(["__texts", "__spans"], parent_dates))
    made = markup.bound(["__texts", "__spans", "__hrefs", "__dates"], collect)
    return markup.without_temporaries(dated.withColumn("anchors", made))


def first_links(anchors_col: Column, rules: Rules = DEFAULT) -> Column:
    """The kept links of one page with ``doc_id``; of equal ids the first one stays.

    Sorting by (id, position) inside the row puts equal ids next to each other: n log n, whatever the page. With
    ``compat`` external links are never dropped, only what follows an equal id is.
    """
    kept = F.transform(
        F.filter(anchors_col, lambda a: keep_link(a["href"], a["text"], rules)),
        lambda a: F.struct(urls.document_id(a["href"]).alias("doc_id"), a["pos"].alias("pos"), a.alias("link")),
    )

    def firsts(ordered: Column) -> Column:
        def stays(a: Column, i: Column) -> Column:
            first = F.coalesce(F.get(ordered, i - 1)["doc_id"] != a["doc_id"], F.lit(True))
            return first | urls.is_external(a["link"]["href"]) if rules.compat else first

        return F.filter(ordered, stays)

    return let(F.sort_array(kept), firsts)


def document_links(
    index_pages: DataFrame,
    key: str = "page_id",
    html: str = "html",
    base: str | None = None,
    rules: Rules = DEFAULT,
    with_dates: bool = True,
) -> DataFrame:
    """(key, pos, doc_id, href, title, url, date, raw_date_str), one row per listed document; narrow.

    ``base`` names the column with the base URL; without it ``rules.site_base`` is used.
    """
    base_url = F.col(base) if base else F.lit(rules.site_base)
    found = index_pages.select(key, html, base_url.alias("base_url")).transform(anchors, html, with_dates)
    found = found.withColumn("__links", first_links(F.col("anchors"), rules))

    def finished(base_column: Column, kept: Column) -> Column:
        def row(a: Column) -> Column:
            link = a["link"]
            raw = F.coalesce(link["raw_date"], F.lit("")) if with_dates else F.lit("")
            return F.struct(
                a["pos"].cast("bigint").alias("pos"),
                a["doc_id"].alias("doc_id"),
                link["href"].alias("href"),
                link["text"].alias("title"),
                urls.absolute_url(base_column, link["href"]).alias("url"),
                (iso_date(raw) if with_dates else F.lit(None).cast("string")).alias("date"),
                raw.alias("raw_date_str"),
            )

        return F.transform(kept, row)

    return found.select(key, F.inline(markup.bound(["base_url", "__links"], finished)))
