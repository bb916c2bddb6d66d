"""Page to content: the whole chain from markup to paragraphs, one narrow stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import markup
from quire.functions.text import py_strip
from quire.operators import paragraphs as para
from quire.operators import regions
from quire.operators.images import refs_of
from quire.operators.markup_rows import is_plain_text
from quire.operators.settle import settled
from quire.rules import DEFAULT, Rules


def region_text(region: Column, rules: Rules = DEFAULT) -> Column:
    """Text of a region with paragraph breaks: at block tags, or (compat) wherever two text nodes meet."""
    if rules.compat:
        return markup.joined_text(region)
    return markup.block_text(region, rules.block_tags)


def document_text(df: DataFrame, bare: str = "bare", rules: Rules = DEFAULT) -> DataFrame:
    """Skeleton to text: navigation out, main region, line breaks, lone links out, headers apart. Adds ``image_numbers``:
    which images of the page the chosen region holds."""
    numbered = df.withColumn(bare, markup.with_numbered_images(F.col(bare)))
    region = numbered.transform(regions.remove_navigation, bare, rules).transform(regions.main_region, bare, rules)
    region = region.withColumn("image_numbers", markup.image_numbers(F.col(bare)))
    cleaned = (
        region.withColumn(bare, markup.bare_br_to_breaks(markup.without_image_numbers(F.col(bare))))
        .transform(regions.remove_lone_links, bare, rules)
        .transform(regions.break_headers, bare, rules)
    )
    return cleaned.withColumn(bare, region_text(F.col(bare), rules))


def extract_content(
    pages: DataFrame, html: str = "html", title: str = "title", rules: Rules = DEFAULT, base: str | None = None
) -> DataFrame:
    """Replace ``html`` by ``paragraphs`` (null for plain text), ``content_html`` and ``n_chars``.

    With ``base``, a column of base URLs, also ``image_refs`` (I1): the images of the chosen region, navigation images
    left out.

    One narrow stage: each page is parsed in its own row, so nothing is shuffled and a hot site or key does not matter.
    """
    plain = is_plain_text(F.col(html))
    marked = pages.withColumn("bare", F.when(~plain, markup.skeleton(F.col(html))))
    texts = marked.transform(document_text, "bare", rules)
    split = texts.withColumn("paragraphs", para.split_paragraphs(F.col("bare"), rules))
    kept = split.withColumn("paragraphs", para.keep_content(F.col("paragraphs"), F.col(title), rules))
    kept = kept.withColumn("paragraphs", para.trim_tail(F.col("paragraphs")))
    content = F.when(plain, para.plain_text_to_html(F.col(html), rules)).otherwise(
        para.wrap_paragraphs(F.col("paragraphs"))
    )
    kept = kept.withColumn("content_html", content)
    if base:
        kept = kept.withColumn("image_refs", refs_of(F.col(html), F.col(base), F.col("image_numbers"), rules))
    total = F.aggregate("paragraphs", F.lit(0), lambda n, p: n + F.length(p))
    sized = kept.withColumn("n_chars", F.when(plain, content_length(F.col("content_html"))).otherwise(total))
    return settled(sized.drop("bare", "image_numbers", html))


def content_length(content_html: Column) -> Column:
    """Length of the stripped text of a piece of markup."""
    return F.length(markup.node_text(markup.skeleton(content_html)))


def region_paragraphs(
    pages: DataFrame, key: str = "page_id", html: str = "html", rules: Rules = DEFAULT
) -> DataFrame:
    """(key, paragraphs): main region split at block tags, whitespace normalised; the smallest useful chain."""
    bare = pages.select(key, markup.skeleton(F.col(html)).alias("bare"))
    region = bare.transform(regions.main_region, "bare", rules)
    return settled(
        region.select(key, para.split_paragraphs(region_text(F.col("bare"), rules), rules).alias("paragraphs"))
    )


def non_empty(content_html: Column) -> Column:
    """SRC1: fetched and not blank."""
    return content_html.isNotNull() & (py_strip(content_html) != "")
