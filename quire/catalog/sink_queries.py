"""Queries that write to the shared folder and read back: stores, versions, state files, collections (SRC3, SRC4, SNK3-SNK5,
N3, C11, SNK2 with images). Every run writes under a name of its own."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.catalog.base import CONTENT_SQL, REGISTRY_SQL, load, query, registry_table, stored_content
from quire.catalog.collection_queries import _SPINE, _collections, _content, _DOCS, _order_sql
from quire.catalog.registry_queries import _NEW, SEEN_AT, _new_content
from quire.operators import chapters, registry
from quire.operators.ranking import scratch_folder
from quire.plans.build import content_rows, shown_images
from quire.rules import ORDERS
from quire.sources import pages, registry_json
from quire.sources.content_store import ContentStore
from quire.sources.versioned import VersionedTable


def _folder(spark: SparkSession) -> str:
    return f"{scratch_folder(spark).rstrip('/')}/catalog-{uuid.uuid4().hex}"


def _rows(content: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return content_rows(
        content.withColumns({
            "url": none, "title": none, "n_chars": F.length("content_html"), "page_date": none, "page_raw_date": none,
        })
    )


def _store(spark: SparkSession, content: DataFrame) -> ContentStore:
    store = ContentStore(spark, _folder(spark))
    store.append(_rows(content))
    return store


@query("SRC3_read_state", f"SELECT doc_id, title, url, date, raw_date_str, read FROM ({REGISTRY_SQL})")
def read_state(spark, sf_dir):
    path = _folder(spark)
    registry_json.write_state(registry_table(spark, sf_dir), path, SEEN_AT)
    return registry_json.read_state_parts(spark, path).select("doc_id", "title", "url", "date", "raw_date_str", "read")


@query("SRC3_state_files", f"SELECT doc_id, title, url, date, raw_date_str, read FROM ({REGISTRY_SQL})")
def read_state_files(spark, sf_dir):
    """Whole state files in the indented layout, each read by as many tasks as it has blocks."""
    path = _folder(spark)
    registry_json.write_state_files(registry_table(spark, sf_dir), path, SEEN_AT)
    return registry_json.read_state(spark, path).select("doc_id", "title", "url", "date", "raw_date_str", "read")


@query("SRC4_stored_content", CONTENT_SQL)
def content_of_store(spark, sf_dir):
    return _store(spark, stored_content(spark, sf_dir)).read().select("doc_id", "content_html")


@query("N3_new_generation", _NEW)
def new_generation(spark, sf_dir):
    """What a forced refresh leaves: only what was stored after it."""
    store = _store(spark, stored_content(spark, sf_dir))
    store.new_generation("forced")
    store.append(_rows(_new_content(spark, sf_dir)))
    return store.read().select("doc_id", "content_html")


@query("SNK3_cleared_store", f"SELECT count(*) AS cleared, CAST(0 AS BIGINT) AS remaining FROM ({CONTENT_SQL})")
def cleared_store(spark, sf_dir):
    store = _store(spark, stored_content(spark, sf_dir))
    cleared = store.new_generation("cleared")
    return store.read().agg(F.lit(cleared).cast("long").alias("cleared"), F.count(F.lit(1)).alias("remaining"))


@query("SNK5_cleared_registry", f"SELECT count(*) AS cleared, CAST(0 AS BIGINT) AS remaining FROM ({REGISTRY_SQL})")
def cleared_registry(spark, sf_dir):
    table = VersionedTable(spark, _folder(spark), registry.SCHEMA)
    table.write(registry_table(spark, sf_dir))
    cleared = table.clear()
    return table.read().agg(F.lit(cleared).cast("long").alias("cleared"), F.count(F.lit(1)).alias("remaining"))


def _write_book(spark, sf_dir, **options) -> str:
    """The folder of the written collections. What order and contents need of the chapters is stored first, and so is the
    order: texts are read once for that and once for the chapters themselves."""
    made, path = _collections(spark, sf_dir), _folder(spark)
    keys = _stored(made.select("collection", "doc_id", "date", "title", "read", "first_pos", "chapter_title", "chapter_id"), f"{path}-keys")
    spine = _stored(chapters.spine(keys), f"{path}-order")
    sizes = spine.groupBy("collection").count()
    pages.write_collection(made, spine, chapters.toc(keys, spine), sizes, path, **options)
    return path


def _stored(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@query("SNK4_written_collections", f"SELECT collection, doc_id, ordinal FROM ({_SPINE})")
def written_collections(spark, sf_dir):
    path = _write_book(spark, sf_dir)
    written = spark.read.parquet(f"{path}/chapters").select("doc_id", F.col("collection").cast("string").alias("collection"))
    return spark.read.parquet(f"{path}/spine").join(written, ["collection", "doc_id"]).select("collection", "doc_id", "ordinal")


@query("SNK4_book_in_order", f"""
  SELECT collection, doc_id, ordinal, CAST((ordinal - 1) // 100 AS INTEGER) AS part,
         CAST((ordinal - 1) % 100 + 1 AS BIGINT) AS place FROM ({_SPINE})""")
def book_in_order(spark, sf_dir):
    """Written chapters with the place each has in its file, read as the file lies."""
    path = _write_book(spark, sf_dir, chapters_a_part=100)
    stored = spark.read.parquet(f"{path}/chapters").withColumn("collection", F.col("collection").cast("string"))
    return stored.select("collection", "doc_id", "ordinal", "part", (F.col("_metadata.row_index") + 1).alias("place"))


def _ordered_sql(way: str) -> str:
    return f"SELECT '{way}' AS way, collection, doc_id, row_number() OVER (PARTITION BY collection ORDER BY {_order_sql(way)}) AS ordinal FROM ({_DOCS})"


@query("C11_accepted_orders", f"{_ordered_sql('asc')} UNION ALL {_ordered_sql('desc')}")
def accepted_orders(spark, sf_dir):
    """Every order there is, and the error for one that is none."""
    try:
        chapters.spine(_content(spark, sf_dir), order="sideways")
    except ValueError:
        found = [chapters.spine(_content(spark, sf_dir), order=w, exact_parallel=False).withColumn("way", F.lit(w)) for w in sorted(ORDERS)]
        return found[0].unionByName(found[1]).select("way", "collection", "doc_id", "ordinal")
    raise AssertionError("an unknown order was accepted")


# Every page shows a picture of its own and one of its language; pages of odd id also a decorative one.
_PICTURES = """
  SELECT page_id, 'https://img.example/p' || page_id || '.gif' AS url, 0 AS pos FROM pages
  UNION ALL SELECT page_id, 'https://img.example/l' || page_id % 7 || '.png', 1 FROM pages"""
_NAME = "md5(url) || CASE WHEN url LIKE '%.gif' THEN '.gif' ELSE '.png' END"


def _parsed_with_images(spark, sf_dir):
    page = F.col("page_id").cast("string")
    pics = [F.concat(F.lit("https://img.example/p"), page, F.lit(".gif")), F.concat(F.lit("https://img.example/l"), F.col("page_id") % 7, F.lit(".png"))]
    refs = F.array(*[
        F.struct(F.lit(i).cast("long").alias("pos"), u.alias("src"), u.alias("url"), F.concat(F.md5(u), F.lit(e)).alias("file_name"))
        for i, (u, e) in enumerate([(pics[0], ".gif"), (pics[1], ".png"), (F.lit("https://img.example/spacer.gif"), ".gif")])
    ])
    none = F.lit(None).cast("string")
    found = load(spark, sf_dir, "pages").select(
        page.alias("doc_id"), "url", none.alias("title"), F.col("url").alias("content_html"), F.length("url").alias("n_chars"),
        none.alias("page_date"), none.alias("page_raw_date"), refs.alias("image_refs"),
    )
    files = found.select(F.inline("image_refs")).select("url").distinct()
    return found, files.select("url", F.lit(60).alias("width"), F.lit(50).alias("height"), F.col("url").cast("binary").alias("data"))


@query(
    "SNK2_content_with_images",
    f"SELECT CAST(page_id AS VARCHAR) AS doc_id, CAST(pos AS BIGINT) AS pos, {_NAME} AS file_name, url AS data FROM ({_PICTURES})",
)
def content_with_images(spark, sf_dir):
    found, files = _parsed_with_images(spark, sf_dir)
    store = ContentStore(spark, _folder(spark))
    store.append(content_rows(found, files))
    return store.read().select("doc_id", F.posexplode("images").alias("pos", "i")).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), F.col("i.filename").alias("file_name"), F.decode("i.data", "UTF-8").alias("data")
    )


@query(
    "I7_images_of_built_content",
    f"""SELECT file_name, ordinal, doc_id FROM (SELECT {_NAME} AS file_name, page_id AS ordinal, CAST(page_id AS VARCHAR) AS doc_id,
          row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM ({_PICTURES})) WHERE rn = 1""",
)
def images_of_built_content(spark, sf_dir):
    found, files = _parsed_with_images(spark, sf_dir)
    spine = found.select(F.lit("all").alias("collection"), F.col("doc_id").cast("long").alias("ordinal"), "doc_id")
    return shown_images(content_rows(found, files), spine).select("file_name", "ordinal", "doc_id")
