"""Publication dates from page markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import markup
from quire.functions.dates import MONTH_NAMES, parse_date
from quire.functions.text import BLANK, decode_entities

# How a date looks at the start of a page's text.
_SPACE = rf"(?:{BLANK}|&nbsp;|&#160;)"  # page source, so not decoded yet
_DATE_BEFORE_BR = rf">([A-Z][a-z]+{_SPACE}\d{{4}}(?:,{_SPACE}rev\.{_SPACE}[A-Z][a-z]+{_SPACE}\d{{4}})?){_SPACE}*<br"
_YEAR_ALONE = rf">{_SPACE}*(\d{{4}}){_SPACE}*(?:<|[\n\r])"
_STARTS_WITH_DATE = rf"(?i)^(?:{MONTH_NAMES}){BLANK}+\d{{4}}"
_STARTS_WITH_YEAR = rf"^(\d{{4}}){BLANK}"

_INVISIBLE = r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>)"
_CONTENT_FONT = {"size": "2", "face": "verdana"}


def with_page_date(
    df: DataFrame, html: str = "html", date: str = "page_date", raw: str = "page_raw_date"
) -> DataFrame:
    """Adds the date a page states about itself, and its raw text; narrow.

    Searched in order: the first content font (a date before a line break anywhere, a bare year in its first 200
    characters); the first five fonts (first 500 and 200 characters); the stripped text of the first ten font, p or div
    elements. The first hit counts even when it does not parse.
    """
    tags = markup.TAG
    raw_html = F.regexp_replace(F.col(html), F.lit(_INVISIBLE), F.lit(""))
    marked = df.withColumn("__raw", raw_html).withColumns(
        {"__texts": F.split("__raw", tags, -1), "__tags": F.regexp_extract_all("__raw", F.lit(tags), F.lit(0))}
    )
    marked = marked.withColumn(
        "__names",
        F.transform("__tags", lambda m: F.lower(F.regexp_extract(m, r"^<(/?[A-Za-z][A-Za-z0-9:-]*)", 1))),
    )
    marked = markup.with_elements(
        marked, F.col("__names"), F.transform("__texts", lambda t: F.lit(0)), into="__all"
    ).withColumn("__spans", F.filter("__all", lambda s: s["tag"].isin("font", "p", "div")))

    def source_of(marks: Column, texts: Column, s: Column) -> Column:
        inside = F.zip_with(
            F.slice(marks, s["open"] + 1, s["close"] - s["open"] + 1),
            F.slice(texts, s["open"] + 2, s["close"] - s["open"]),
            lambda m, t: F.concat(m, F.coalesce(t, F.lit(""))),
        )
        return F.array_join(inside, "")

    def before_break(source: Column) -> Column:
        return F.regexp_extract(source, _DATE_BEFORE_BR, 1)

    def year_alone(source: Column) -> Column:
        return F.regexp_extract(F.substring(source, 1, 200), _YEAR_ALONE, 1)

    def candidates(marks: Column, texts: Column, spans: Column) -> Column:
        fonts = F.filter(spans, lambda s: s["tag"] == "font")
        content = F.slice(
            F.filter(
                fonts,
                lambda s: (markup.attribute(F.get(marks, s["open"]), "size") == _CONTENT_FONT["size"])
                & (markup.attribute(F.get(marks, s["open"]), "face") == _CONTENT_FONT["face"]),
            ),
            1, 1,
        )
        whole = F.transform(content, lambda s: source_of(marks, texts, s))
        heads = F.transform(F.slice(fonts, 1, 5), lambda s: F.substring(source_of(marks, texts, s), 1, 500))
        starts = F.transform(
            F.slice(spans, 1, 10),
            lambda s: F.substring(markup.node_text(markup.skeleton(source_of(marks, texts, s))), 1, 200),
        )
        def first_hit(values: Column, *patterns) -> Column:
            hits = F.flatten(F.transform(values, lambda v: F.array(*[p(v) for p in patterns])))
            return F.get(F.filter(hits, lambda h: h != ""), F.lit(0))

        # coalesce stops at the first hit, so later stages cost nothing on dated pages.
        return F.coalesce(
            first_hit(whole, before_break, year_alone),
            first_hit(heads, before_break, year_alone),
            first_hit(
                starts,
                lambda t: F.regexp_extract(t, _STARTS_WITH_DATE, 0),
                lambda t: F.regexp_extract(t, _STARTS_WITH_YEAR, 1),
            ),
            F.lit(""),
        )

    found = marked.withColumn("__hit", markup.bound(["__tags", "__texts", "__spans"], candidates))
    parsed = parse_date(decode_entities(F.col("__hit")))
    return markup.without_temporaries(
        found.withColumns({date: parsed["date"], raw: parsed["raw_date_str"]})
    )


def prefer_page_date(df: DataFrame, page_date: str = "page_date", page_raw: str = "page_raw_date") -> DataFrame:
    """D3: the page's own date replaces ``date``/``raw_date_str`` when there is one."""
    found = F.col(page_date).isNotNull()
    return df.withColumns(
        {
            "date": F.when(found, F.col(page_date)).otherwise(F.col("date")),
            "raw_date_str": F.when(found, F.col(page_raw)).otherwise(F.col("raw_date_str")),
        }
    ).drop(page_date, page_raw)
