"""Image references and images of a collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import markup, urls
from quire.functions.arrays import contains_any, let
from quire.functions.text import plain_base64
from quire.operators.regions import is_navigation_image
from quire.rules import DEFAULT, Rules


def is_decorative(url: Column, rules: Rules = DEFAULT) -> Column:
    """I2"""
    return contains_any(F.lower(url), rules.decorative)


def is_large_enough(width: Column, height: Column, rules: Rules = DEFAULT) -> Column:
    """Both sides known to be long enough."""
    return (width >= rules.min_image_side) & (height >= rules.min_image_side)


REFS = "array<struct<pos:bigint,src:string,url:string,file_name:string>>"


def refs_of(html: Column, base: Column, numbers: Column | None = None, rules: Rules = DEFAULT) -> Column:
    """Array of (pos, src, url, file_name) of each usable <img>, in document order.

    ``numbers`` keeps only these images of the page, counted from 0. Images without ``src`` and navigation images are
    left out; relative addresses are joined to the base.
    """
    tags = F.filter(
        F.transform(markup.tokens(html), lambda t, i: F.struct(i.alias("pos"), t.alias("token"))),
        lambda t: t["token"].rlike(r"(?i)^<img[\s/>]"),
    )
    if numbers is not None:
        tags = let(tags, lambda found: F.transform(numbers, lambda n: F.get(found, n)))
    attributes = F.transform(
        tags,
        lambda t: F.struct(
            t["pos"].cast("bigint").alias("pos"),
            markup.attribute(t["token"], "src").alias("src"),
            markup.attribute(t["token"], "alt").alias("alt"),
        ),
    )

    def resolved(row: Column) -> Column:
        usable = F.filter(row["found"], lambda i: (i["src"] != "") & ~is_navigation_image(i["src"], i["alt"], rules))
        return F.transform(
            usable,
            lambda i: let(
                urls.absolute_url(row["base"], i["src"]),
                lambda url: F.struct(
                    i["pos"].alias("pos"), i["src"].alias("src"), url.alias("url"),
                    urls.image_file_name(url).alias("file_name"),
                ),
            ),
        )

    return let(F.struct(base.alias("base"), attributes.alias("found")), resolved).cast(REFS)


def image_refs(
    pages: DataFrame, key: str = "page_id", html: str = "html", base: str = "url", rules: Rules = DEFAULT
) -> DataFrame:
    """I1 over whole pages: (key, pos, src, url, file_name), narrow. ``extract_content`` has those of the chosen region."""
    return pages.select(key, F.inline(refs_of(F.col(html), F.col(base), rules=rules)))


def wanted_urls(refs: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Each address once, decorative ones left out."""
    return refs.filter(~is_decorative(F.col("url"), rules)).select("url", "file_name").distinct()


def usable_images(images: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Images (url, width, height, ...) that are large enough."""
    return images.filter(is_large_enough(F.col("width"), F.col("height"), rules))


def document_images(refs: DataFrame, images: DataFrame, key: str = "page_id", rules: Rules = DEFAULT) -> DataFrame:
    """(key, pos, url, file_name, media_type), the first reference to each file per document.

    The image table is joined by URL without its bytes, so nothing large is shuffled.
    """
    good = usable_images(images, rules).select("url").distinct()
    kept = refs.filter(~is_decorative(F.col("url"), rules)).join(good, "url", "left_semi")
    first = kept.groupBy(key, "file_name").agg(F.min(F.struct("pos", "url")).alias("first"))
    return first.select(key, "first.pos", "first.url", "file_name", urls.media_type(F.col("file_name")).alias("media_type"))


def with_images(content: DataFrame, images: DataFrame, key: str = "doc_id", rules: Rules = DEFAULT) -> DataFrame:
    """SNK2: ``image_refs`` of content rows replaced by ``images`` (filename, data): I2, I3, I6.

    ``images`` has url, width, height and data. Which image goes where is settled on narrow rows; then bytes join them
    once a document that shows them, as the store keeps them.
    """
    refs = content.select(key, F.inline("image_refs"))
    shown = document_images(refs, images, key, rules)
    one = images.groupBy("url").agg(F.max_by("data", "data").alias("data"))
    listed = shown.join(one, "url").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col("file_name").alias("filename"), "data"))).alias("__images")
    )
    made = F.transform("__images", lambda i: F.struct(i["filename"].alias("filename"), i["data"].alias("data")))
    empty = F.array().cast("array<struct<filename:string,data:binary>>")
    joined = content.drop("image_refs").join(listed, key, "left")
    return joined.withColumn("images", F.coalesce(made, empty)).drop("__images")


def collection_images(doc_images: DataFrame, spine_rows: DataFrame, key: str = "doc_id", collection: str = "collection") -> DataFrame:
    """Each file once per collection, credited to the first chapter that shows it.

    ``min`` of a struct is partially aggregated, so a logo on every page costs one row per task in the shuffle.
    """
    shown = doc_images.join(spine_rows.withColumnRenamed("doc_id", key), key)
    first = shown.groupBy(collection, "file_name").agg(
        F.min(F.struct("ordinal", "pos", F.col(key).alias("doc_id"), "url")).alias("first")
    )
    return first.select(
        collection, "file_name", "first.ordinal", "first.doc_id", "first.url",
        urls.media_type(F.col("file_name")).alias("media_type"),
    )


def rewrite_refs(html: Column, kept: Column) -> Column:
    """I8: point kept images at ``images/<file>`` and drop the others.

    ``kept``: map<src,file_name> of one document. Every <img> token is looked up in it by its ``src``.
    """
    def rewrite(token: Column) -> Column:
        return F.when(
            token.rlike(r"(?i)^<img[\s/>]"),
            let(
                markup.attribute(token, "src"),
                lambda src: let(
                    F.try_element_at(kept, F.coalesce(src, F.lit(""))),
                    lambda file: F.when(file.isNull(), F.lit("")).otherwise(
                        F.regexp_replace(
                            token,
                            F.lit(r"""(?i)(\ssrc\s*=\s*)("[^"]*"|'[^']*'|[^\s"'>]+)"""),
                            F.concat(F.lit('$1"images/'), file, F.lit('"')),
                        )
                    ),
                ),
            ),
        ).otherwise(token)

    return let(kept, lambda _: F.array_join(F.transform(markup.tokens(html), rewrite), ""))


def with_rewritten_refs(
    pages: DataFrame, doc_images: DataFrame, refs: DataFrame, key: str = "page_id", html: str = "html"
) -> DataFrame:
    """I8: pages with their image references rewritten. The map per page is bounded by the page's own references."""
    kept = refs.join(doc_images.select(key, "file_name"), [key, "file_name"], "left_semi")
    maps = (
        kept.select(key, "src", "file_name")
        .distinct()
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("src", "file_name"))).alias("__kept"))
    )
    joined = pages.join(maps, key, "left")
    empty = F.create_map().cast("map<string,string>")
    return joined.withColumn(html, rewrite_refs(F.col(html), F.coalesce(F.col("__kept"), empty))).drop("__kept")


def to_base64(images: DataFrame, data: str = "data") -> DataFrame:
    """I9"""
    return images.withColumn(data, plain_base64(F.col(data)))


def from_base64(images: DataFrame, data: str = "data") -> DataFrame:
    """I9"""
    return images.withColumn(data, F.unbase64(F.col(data)))
