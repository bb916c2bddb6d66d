"""The build: list, register, parse what is new, compile an ordered collection."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.urls import safe_key
from quire.operators import chapters as ch
from quire.operators import incremental, links, registry
from quire.operators.content import extract_content, non_empty
from quire.operators.images import collection_images, with_images
from quire.operators.page_dates import with_page_date
from quire.operators.settle import settled
from quire.rules import DEFAULT, Rules
from quire.sources.content_store import SCHEMA as CONTENT_SCHEMA
from quire.sources.content_store import ContentStore
from quire.sources.pages import write_collection
from quire.sources.versioned import VersionedTable

LISTING_SCHEMA = "pos bigint, doc_id string, href string, title string, url string, date string, raw_date_str string"


@dataclass(frozen=True)
class Collection:
    chapters: DataFrame
    spine: DataFrame
    toc: DataFrame
    metadata: DataFrame
    images: DataFrame


def one_page_per_url(pages: DataFrame) -> DataFrame:
    """The first landed copy of each address, in one pass.

    Spark limits each group to its first row before the shuffle as well, so an address landed in a third of all rows
    is one row per task there.
    """
    first = F.row_number().over(Window.partitionBy("url").orderBy("page_id"))
    return pages.withColumn("__copy", first).filter("__copy = 1").drop("__copy")


def parse_pages(pages: DataFrame, todo: DataFrame, rules: Rules = DEFAULT, images: DataFrame | None = None) -> DataFrame:
    """SRC1, D2, extract_content: content rows for the documents in ``todo`` (doc_id, url, title), with the images of the
    chosen regions out of ``images`` (url, width, height, data), if given.

    The copy to parse is chosen on ids and addresses alone, by an aggregate that combines before the shuffle, and only
    the chosen pages are then looked up by ``page_id``, the key of ``pages``; the optimizer filters or broadcasts by the
    size it measures.
    """
    pages = pages.filter(non_empty(F.col("html"))).select("page_id", "url", "html")
    first = pages.groupBy("url").agg(F.min("page_id").alias("page_id"))
    chosen = todo.select("doc_id", "url", "title").join(first, "url")
    found = chosen.join(pages.drop("url"), "page_id")
    parsed = found.transform(with_page_date).transform(extract_content, rules=rules, base="url")
    return content_rows(parsed, images, rules)


def content_rows(parsed: DataFrame, images: DataFrame | None = None, rules: Rules = DEFAULT) -> DataFrame:
    """Rows of ``ContentStore`` out of parsed pages with doc_id, url, title and image_refs."""
    if images is None:
        parsed = parsed.withColumn("images", F.array().cast("array<struct<filename:string,data:binary>>"))
    else:
        parsed = with_images(settled(parsed), images, rules=rules)
    return parsed.select(
        "doc_id",
        "url",
        "title",
        safe_key(F.col("doc_id")).alias("safe_key"),
        "content_html",
        "n_chars",
        "page_date",
        "page_raw_date",
        "images",
    )


def listed(index_pages: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Links of all index pages with one numbering: pages by id, links by place. The running sum is over one row a page."""
    found = links.document_links(index_pages, rules=rules)
    sizes = found.groupBy("page_id").agg((F.max("pos") + 1).alias("n"))
    before = Window.orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("page_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__shift"))
    return found.join(shifts, "page_id").withColumn("pos", F.col("pos") + F.col("__shift")).drop("page_id", "__shift")


def with_page_dates(known: DataFrame, new_content: DataFrame, all_content: DataFrame) -> DataFrame:
    """D3: registry rows take over the dates freshly parsed pages state about themselves.

    Rows without a date also take the one stored with their content, so a run that died between storing content and
    writing dates loses none.
    """
    of = lambda content, new: content.filter(F.col("page_date").isNotNull()).select(
        "doc_id", F.lit(new).alias("new"), F.col("page_date").alias("d"), F.col("page_raw_date").alias("r")
    )
    dates = of(new_content, True).union(of(all_content, False)).groupBy("doc_id").agg(F.max(F.struct("new", "d", "r")).alias("b"))
    joined = known.join(dates, "doc_id", "left")
    use = F.col("b.new") | F.col("date").isNull()
    return joined.withColumns({"__date": F.when(use, F.col("b.d")), "__raw": F.when(use, F.col("b.r"))}).drop("b").withColumns(
        {
            "date": F.coalesce("__date", "date"),
            "raw_date_str": F.when(F.col("__date").isNotNull(), F.col("__raw")).otherwise(F.col("raw_date_str")),
        }
    ).drop("__date", "__raw")


def compile_collection(
    known: DataFrame,
    content: DataFrame,
    run_date: dt.date,
    order: str = "desc",
    name: str = "all",
    rules: Rules = DEFAULT,
    by_range: bool | None = None,
) -> Collection:
    """One collection out of registry rows and their content."""
    ch.check_order(order)
    docs = incremental.stored(known, content.select("doc_id", "content_html", "n_chars"))
    made = ch.build_chapters(docs, rules).withColumn("collection", F.lit(name))
    spine = ch.spine(made, order=order, exact_parallel=by_range)
    sizes = spine.groupBy("collection").agg(F.count(F.lit(1)).alias("n_chapters"))
    images = with_image_data(shown_images(content, spine), content)
    return Collection(made, spine, ch.toc(made, spine), ch.with_metadata(sizes, run_date, rules), images)


def shown_images(content: DataFrame, spine: DataFrame) -> DataFrame:
    """Each file of a collection once, credited to its first chapter; bytes stay with the content."""
    files = content.select("doc_id", F.posexplode(F.transform("images", lambda i: i["filename"])).alias("pos", "file_name"))
    files = files.withColumn("url", F.lit(None).cast("string"))
    return collection_images(files, spine.select("collection", "ordinal", "doc_id")).drop("url")


def with_image_data(shown: DataFrame, content: DataFrame) -> DataFrame:
    """The files of ``shown_images`` with their bytes, out of the content of the chapter they are credited to.

    The files of a document are gathered first (as many as it shows), so its pictures meet them once and are not copied.
    """
    own = [c for c in shown.columns if c != "doc_id"]
    wanted = shown.groupBy("doc_id").agg(F.collect_list(F.struct(*own)).alias("__files"))
    found = wanted.join(content.select("doc_id", "images"), "doc_id")
    data = lambda f: F.get(F.filter("images", lambda i: i["filename"] == f["file_name"]), F.lit(0))["data"]
    files = F.transform("__files", lambda f: F.struct(*[f[c].alias(c) for c in own], data(f).alias("data")))
    return found.select("doc_id", F.inline(files)).select(*shown.columns, "data")


def build(
    spark: SparkSession,
    root: str,
    pages: DataFrame,
    index_pages: DataFrame | None,
    run_at: dt.datetime,
    order: str = "desc",
    rebuild: bool = False,
    force_refresh: bool = False,
    rules: Rules = DEFAULT,
    output: str | None = None,
    images: DataFrame | None = None,
) -> tuple[Collection, dict[str, int]]:
    """One run against the tables under ``root`` (registry and content).

    normal: index links are registered, documents without content are parsed and stored; rebuild: the registry drives
    and only stored content is used; force: a new content generation, then as normal. Every stage is written before the
    next reads it, so no page is parsed twice and a lost executor repeats one stage only. Of the counts (N5), what was
    on hand comes from file footers and what was parsed is observed by the tasks that write it.
    """
    ch.check_order(order)
    mode = incremental.build_mode(rebuild, force_refresh)
    table = VersionedTable(spark, f"{root}/registry", registry.SCHEMA)
    store = ContentStore(spark, f"{root}/content")
    if mode == "force":
        store.new_generation(run_at.isoformat())
    n_before = store.read().count()
    n_new = 0
    if mode == "rebuild":
        if table.read().isEmpty():
            raise ValueError("no registry found; run a normal build first")
        docs = table.read()
    else:
        listings = VersionedTable(spark, f"{root}/listing", LISTING_SCHEMA)
        listings.write(listed(index_pages, rules))
        listing = listings.read()
        if listing.isEmpty():
            raise ValueError("the index lists no documents")
        table.write(registry.upsert(table.read(), listing, run_at, rules))
        docs = incremental.listed_in_registry(listing.select("doc_id").distinct(), table.read())
        todo = docs.join(store.read_for(listing).select("doc_id"), "doc_id", "left_anti")
        stored = Observation()
        parsed = parse_pages(pages, todo, rules, images).observe(stored, F.count(F.lit(1)).alias("n"))
        batch = store.append(parsed)
        n_new = stored.get["n"]
        new_content = spark.read.schema(CONTENT_SCHEMA).parquet(store._batches().path_of(batch))
        table.write(with_page_dates(table.read(), new_content, store.read()))
        docs = incremental.listed_in_registry(docs.select("doc_id"), table.read())
    collection = compile_collection(docs, store.read(), run_at.date(), order, rules=rules)
    if output:
        write_collection(collection.chapters, collection.spine, collection.toc, collection.metadata, output, collection.images)
    return collection, {"cached": n_before, "fetched": n_new}
