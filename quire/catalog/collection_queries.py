"""Queries for chapters, collections and images (C1-C10, SNK4, I1-I10, SRC6)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from quire.catalog import image_files
from quire.catalog.base import REGISTRY_SQL, load, query, registry_table
from quire.catalog.region_queries import _region_sql, _sql_escape
from quire.functions import markup, text, urls
from quire.operators import chapters, images
from quire.operators.content import content_length
from quire.operators.ranking import scratch_folder
from quire.operators.settle import settled
from quire.rules import DEFAULT
from quire.sources.binary_files import write_files
from quire.sources.pages import folders_for, read_image_folders

_BODY = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _content(spark, sf_dir, measured=False):
    """Documents as stored content with registry fields; the language is the collection.

    ``measured`` texts are so where they are read (``n_chars``), and what needs only keys of chapters shuffles no text.
    """
    docs = load(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("lang").alias("collection"),
        F.concat(F.lit("<p>"), text.escape_body_text(F.col("text")), F.lit("</p>")).alias("content_html"),
    )
    if measured:
        docs = settled(docs).withColumn("n_chars", content_length(markup.strip_wrappers(F.col("content_html"))))
        docs = settled(docs)
    return registry_table(spark, sf_dir).join(docs, "doc_id")


@query(
    "C1_enough_content",
    r"SELECT CAST(doc_id AS VARCHAR) AS doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 100 AS enough FROM documents",
)
def enough_content(spark, sf_dir):
    return _content(spark, sf_dir).select("doc_id", chapters.has_enough_content(F.col("content_html")).alias("enough"))


@query("C2_escaped_text", f"SELECT doc_id, {_sql_escape('text')} AS escaped FROM documents")
def escaped_text(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.escape_html(F.col("text")).alias("escaped"))


_SHOWN = "coalesce(nullif(raw_date_str, ''), nullif(date, ''))"
_CHAPTER_TITLE = f"title || coalesce(' (' || {_SHOWN} || ')', '')"
_CHAPTER = f"""concat_ws(chr(10), '<html xmlns="http://www.w3.org/1999/xhtml">', '<head>',
  '<title>' || {_sql_escape('title')} || '</title>', '<link rel="stylesheet" type="text/css" href="style.css"/>', '</head>', '<body>',
  '<h1>' || {_sql_escape('title')} || '</h1>', '<p class="essay-date">' || {_sql_escape(_SHOWN)} || '</p>',
  '<p>' || body || '</p>', '</body>', '</html>')"""
_DOCS = f"""SELECT r.*, d.lang AS collection, d.text, {_BODY.replace('text', 'd.text')} AS body FROM ({REGISTRY_SQL}) r
            JOIN documents d ON CAST(d.doc_id AS VARCHAR) = r.doc_id"""
_KEPT = rf"SELECT * FROM ({_DOCS}) WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 100"


@query("C3_chapters", f"SELECT doc_id, 'essay_' || doc_id AS chapter_id, {_CHAPTER} AS html FROM ({_KEPT})")
def chapter_pages(spark, sf_dir):
    return chapters.build_chapters(_content(spark, sf_dir)).select("doc_id", "chapter_id", "html")


@query(
    "C4_chapters_with_body",
    f"SELECT page_id, text <> '' AS with_text, false AS without_text FROM ({_region_sql(10**9)})",
)
def chapters_with_body(spark, sf_dir):
    emptied = F.regexp_replace("html", F.lit(r"(?is)<body>.*$"), F.lit("<body> <br> </body>"))
    return load(spark, sf_dir, "pages").select(
        "page_id", chapters.has_body(F.col("html")).alias("with_text"), chapters.has_body(emptied).alias("without_text")
    )


@query("C5_chapter_titles", f"SELECT doc_id, {_CHAPTER_TITLE} AS chapter_title FROM ({REGISTRY_SQL})")
def chapter_titles(spark, sf_dir):
    made = chapters.chapter_title(F.col("title"), F.col("raw_date_str"), F.col("date"))
    return registry_table(spark, sf_dir).select("doc_id", made.alias("chapter_title"))


@query("C6_safe_keys", "SELECT page_id, replace(replace(url, '/', '_'), '.html', '') AS safe_key FROM pages")
def safe_keys(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", urls.safe_key(F.col("url")).alias("safe_key"))


@query(
    "C6_clashing_keys",
    """SELECT safe_key, count(DISTINCT url) AS n_docs FROM (
         SELECT url, replace(replace(url, '/', '_'), '.html', '') AS safe_key
         FROM (SELECT url FROM pages UNION ALL SELECT replace(url, '/', '_') FROM pages)) GROUP BY 1 HAVING count(DISTINCT url) > 1""",
)
def clashing_keys(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    both = pages.select("url").unionByName(pages.select(F.replace("url", F.lit("/"), F.lit("_")).alias("url")))
    return chapters.clashing_keys(both, "url")


def _order_sql(way: str) -> str:
    return f"""nullif(date, '') IS NULL, nullif(date, '') {way} NULLS LAST, CASE WHEN nullif(date, '') IS NOT NULL THEN title END {way} NULLS LAST,
               title, read, first_pos"""


def _spine_query(name: str, order: str):
    @query(
        name,
        f"SELECT collection, doc_id, row_number() OVER (PARTITION BY collection ORDER BY {_order_sql(order)}) AS ordinal FROM ({_DOCS})",
    )
    def run(spark, sf_dir):
        return chapters.spine(_content(spark, sf_dir), order=order)


_spine_query("C7_reading_order_newest_first", "desc")
_spine_query("C7_reading_order_oldest_first", "asc")
_spine_query("C7_reading_order_by_ranges", "desc")


def _reversible_query(name: str, order: str):
    @query(
        name,
        f"""SELECT doc_id, row_number() OVER (ORDER BY nullif(date, '') IS NULL {order}, coalesce(nullif(date, ''), title) {order},
                   read, first_pos) AS ordinal FROM ({REGISTRY_SQL})""",
    )
    def run(spark, sf_dir):
        known = registry_table(spark, sf_dir).select("doc_id", "date", "title", "read", "first_pos")
        ranked = chapters.numbered(known, [F.lit(1)], chapters.reversible_keys(order), "ordinal", True)
        return ranked.select("doc_id", "ordinal")


_reversible_query("C8_reversible_order_descending", "desc")
_reversible_query("C8_reversible_order_ascending", "asc")

_SPINE = f"SELECT collection, doc_id, row_number() OVER (PARTITION BY collection ORDER BY {_order_sql('desc')}) AS ordinal FROM ({_KEPT})"


@query(
    "C9_spine",
    f"""SELECT collection, ordinal + 1 AS position, 'essay_' || doc_id AS item FROM ({_SPINE})
        UNION ALL SELECT DISTINCT collection, 0, 'cover' FROM ({_KEPT}) UNION ALL SELECT DISTINCT collection, 1, 'nav' FROM ({_KEPT})""",
)
def spine_items(spark, sf_dir):
    made = _collections(spark, sf_dir)
    return chapters.spine_items(chapters.spine(made, exact_parallel=False), cover=True)


def _collections(spark, sf_dir):
    return chapters.build_chapters(_content(spark, sf_dir, measured=True), keep=("collection",))


@query(
    "C9_table_of_contents",
    f"""SELECT collection, 'Essays' AS section, ordinal, {_CHAPTER_TITLE} AS title, 'essay_' || doc_id || '.xhtml' AS file_name
        FROM ({_KEPT}) JOIN ({_SPINE}) USING (collection, doc_id)""",
)
def table_of_contents(spark, sf_dir):
    made = _collections(spark, sf_dir)
    return chapters.toc(made, chapters.spine(made, exact_parallel=False))


META_RULES = DEFAULT.but(collection_title="Readings", author="Various", publisher="example.org", identifier_prefix="readings")


@query(
    "C10_collection_metadata",
    """SELECT lang AS collection, count(*) AS n_docs, 'readings-20240229' AS identifier, 'Readings - 2024-02-29' AS title,
              'en' AS language, 'Various' AS author, 'example.org' AS publisher FROM documents GROUP BY 1""",
)
def collection_metadata(spark, sf_dir):
    sizes = load(spark, sf_dir, "documents").groupBy(F.col("lang").alias("collection")).agg(F.count(F.lit(1)).alias("n_docs"))
    return chapters.with_metadata(sizes, dt.date(2024, 2, 29), META_RULES)


# --- images --------------------------------------------------------------------------------------------------

_IMG = """html || '<img src="/pic/' || page_id || '.gif" alt="a chart"><IMG alt="" src="' || url || '.png"><img><img src="">
<img src="x.jpg" alt="Home"><img src="/pic/' || page_id || '.gif">'"""
_SITE = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"


def _with_images(spark, sf_dir):
    key = F.col("page_id").cast("string")
    html = F.concat(
        "html", F.lit('<img src="/pic/'), key, F.lit('.gif" alt="a chart"><IMG alt="" src="'), "url",
        F.lit('.png"><img><img src="">\n<img src="x.jpg" alt="Home"><img src="/pic/'), key, F.lit('.gif">'),
    )
    return load(spark, sf_dir, "pages").withColumn("html", html)


IMAGE_RULES = DEFAULT.but(nav_keywords=("home",), decorative=("spam-farm", "blog."))
_REFS = f"""
  SELECT page_id, 1 AS n, '/pic/' || page_id || '.gif' AS src, {_SITE} || '/pic/' || page_id || '.gif' AS url FROM pages
  UNION ALL SELECT page_id, 2, url || '.png', url || '.png' FROM pages
  UNION ALL SELECT page_id, 3, '/pic/' || page_id || '.gif', {_SITE} || '/pic/' || page_id || '.gif' FROM pages"""
_FILE = """md5(url) || CASE WHEN lower(url) LIKE '%.png' THEN '.png' WHEN lower(url) LIKE '%.gif' THEN '.gif'
                            WHEN lower(url) LIKE '%.webp' THEN '.webp' ELSE '.jpg' END"""


@query("I1_image_references", f"SELECT page_id, src, url, {_FILE} AS file_name FROM ({_REFS})")
def image_references(spark, sf_dir):
    return images.image_refs(_with_images(spark, sf_dir), rules=IMAGE_RULES).select("page_id", "src", "url", "file_name")


@query("I2_decorative_images", "SELECT page_id, contains(lower(url), 'spam-farm') OR contains(lower(url), 'blog.') AS decorative FROM pages")
def decorative_images(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    return pages.select("page_id", images.is_decorative(F.col("url"), IMAGE_RULES).alias("decorative"))


_FILES_SQL = """SELECT p_partkey, ['png', 'gif', 'webp', 'bad'][p_partkey % 4 + 1] AS kind,
                       p_size * 2 AS width, p_size * 3 AS height FROM part"""


def _image_files(spark, sf_dir):
    """A file for every part, in the shared scratch folder: three formats, and every fourth one no image."""
    kinds = F.array(*map(F.lit, image_files.KINDS))
    rows = load(spark, sf_dir, "part").select(
        F.get(kinds, (F.col("p_partkey") % 4).cast("int")).alias("kind"), "p_partkey",
        (F.col("p_size") * 2).cast("int").alias("width"), (F.col("p_size") * 3).cast("int").alias("height"),
    ).withColumn("name", F.format_string("%d.%s", "p_partkey", F.when(F.col("kind") == "bad", "png").otherwise(F.col("kind"))))
    path = f"{scratch_folder(spark)}/images-{uuid.uuid4().hex}"
    folders = folders_for(rows.count())
    spread = rows.repartition(spark.sparkContext.defaultParallelism)
    encoded = spread.select("name", "kind", "width", "height").mapInPandas(image_files.encode, "name string, data binary")
    write_files(encoded, path, folders)
    return read_image_folders(spark, path, folders, f"{path}-sizes")


@query("SRC6_image_files", f"SELECT p_partkey, '.' || kind AS suffix, CAST(width AS INT) AS width, CAST(height AS INT) AS height FROM ({_FILES_SQL}) WHERE kind <> 'bad'")
def image_files_read(spark, sf_dir):
    key = F.regexp_extract("path", r"(\d+)\.[a-z]+$", 1).cast("long").alias("p_partkey")
    return _image_files(spark, sf_dir).select(key, "suffix", "width", "height")


@query(
    "I3_decoded_sizes",
    f"SELECT kind, count(*) AS n_files, sum(width) AS widths FROM ({_FILES_SQL}) WHERE kind <> 'bad' AND width >= 50 AND height >= 50 GROUP BY kind",
)
def decoded_sizes(spark, sf_dir):
    """Images whose decoded size is large enough."""
    large = images.usable_images(_image_files(spark, sf_dir))
    kind = F.substring("suffix", 2, 10).alias("kind")
    return large.groupBy(kind).agg(F.count("*").alias("n_files"), F.sum("width").alias("widths"))


@query("I3_large_images", "SELECT p_partkey, p_size * 2 AS width, p_size * 3 AS height FROM part WHERE p_size * 2 >= 50 AND p_size * 3 >= 50")
def large_images(spark, sf_dir):
    sized = load(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_size") * 2).alias("width"), (F.col("p_size") * 3).alias("height")
    )
    return images.usable_images(sized)


_URLS = """SELECT page_id, url FROM pages UNION ALL SELECT page_id, url || '.PNG' FROM pages
           UNION ALL SELECT page_id, url || '.gif' FROM pages UNION ALL SELECT page_id, url || '.webp?x=1' FROM pages
           UNION ALL SELECT page_id, url || '.webp' FROM pages"""


def _image_urls(spark, sf_dir):
    endings = F.array(*[F.lit(e) for e in ("", ".PNG", ".gif", ".webp?x=1", ".webp")])
    return load(spark, sf_dir, "pages").select("page_id", "url", F.explode(endings).alias("e")).select(
        "page_id", F.concat("url", "e").alias("url")
    )


@query("I4_file_names", f"SELECT page_id, url, {_FILE} AS file_name FROM ({_URLS})")
def file_names(spark, sf_dir):
    return _image_urls(spark, sf_dir).withColumn("file_name", urls.image_file_name(F.col("url")))


@query(
    "I5_media_types",
    f"""SELECT page_id, url, CASE WHEN lower(url) LIKE '%.png' THEN 'image/png' WHEN lower(url) LIKE '%.gif' THEN 'image/gif'
          WHEN lower(url) LIKE '%.webp' THEN 'image/webp' ELSE 'image/jpeg' END AS media_type FROM ({_URLS})""",
)
def media_types(spark, sf_dir):
    return _image_urls(spark, sf_dir).withColumn("media_type", urls.media_type(F.col("url")))


@query(
    "I6_document_images",
    f"""SELECT page_id, min(n) AS n, {_FILE} AS file_name FROM ({_REFS}) GROUP BY page_id, url""",
)
def document_images(spark, sf_dir):
    refs = images.image_refs(_with_images(spark, sf_dir), rules=IMAGE_RULES)
    sizes = refs.select("url", F.lit(60).alias("width"), F.lit(50).alias("height"))
    kept = images.document_images(refs, sizes, rules=DEFAULT)
    ranks = refs.select("page_id", "pos", F.row_number().over(_by_page()).alias("n"))
    return kept.join(ranks, ["page_id", "pos"]).select("page_id", F.col("n").cast("bigint").alias("n"), "file_name")


def _by_page():
    from pyspark.sql import Window

    return Window.partitionBy("page_id").orderBy("pos")


@query(
    "I7_collection_images",
    """SELECT collection, file_name, ordinal, doc_id FROM (
         SELECT c_mktsegment AS collection, md5(o_orderpriority || o_orderstatus) || '.jpg' AS file_name, c_custkey AS ordinal,
                c_custkey AS doc_id, row_number() OVER (PARTITION BY c_mktsegment, o_orderpriority, o_orderstatus ORDER BY c_custkey) AS rn
         FROM orders JOIN customer ON o_custkey = c_custkey) WHERE rn = 1""",
)
def collection_images(spark, sf_dir):
    spine = load(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("collection"), F.col("c_custkey").alias("ordinal"), F.col("c_custkey").alias("doc_id")
    )
    url = F.concat("o_orderpriority", "o_orderstatus")
    shown = load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), url.alias("url"),
        urls.image_file_name(url).alias("file_name"),
    )
    return images.collection_images(shown, spine).select("collection", "file_name", "ordinal", "doc_id")


@query(
    "I8_rewritten_references",
    f"""SELECT page_id, html || '<img src="images/' || md5(site || '/pic/' || page_id || '.gif') || '.gif" alt="a chart">' ||
               CASE WHEN contains(url, 'blog.') OR contains(url, 'spam-farm') THEN ''
                    ELSE '<IMG alt="" src="images/' || md5(url || '.png') || '.png">' END || chr(10) ||
               '<img src="images/' || md5(site || '/pic/' || page_id || '.gif') || '.gif">' AS html
        FROM (SELECT *, {_SITE} AS site FROM pages) WHERE NOT (contains(url, 'blog.') OR contains(url, 'spam-farm'))
        UNION ALL SELECT page_id, html || chr(10) FROM pages WHERE contains(url, 'blog.') OR contains(url, 'spam-farm')""",
)
def rewritten_references(spark, sf_dir):
    pages = _with_images(spark, sf_dir)
    refs = images.image_refs(pages, rules=IMAGE_RULES)
    sizes = refs.select("url", F.lit(60).alias("width"), F.lit(50).alias("height"))
    kept = images.document_images(refs, sizes, rules=IMAGE_RULES)
    return images.with_rewritten_refs(pages, kept, refs).select("page_id", "html")


@query("I9_base64", "SELECT doc_id, base64(encode(text)) AS data, text AS decoded FROM documents")
def base64_data(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    encoded = images.to_base64(docs)
    back = images.from_base64(encoded.withColumn("decoded", F.col("data")), "decoded")
    return back.select("doc_id", "data", F.decode("decoded", "UTF-8").alias("decoded"))


@query("I10_wanted_urls", f"SELECT DISTINCT url, {_FILE} AS file_name FROM (SELECT event_type || user_id || '.png' AS url FROM events) WHERE NOT contains(url, 'click')")
def wanted_urls(spark, sf_dir):
    url = F.concat("event_type", F.col("user_id").cast("string"), F.lit(".png"))
    refs = load(spark, sf_dir, "events").select(url.alias("url")).withColumn("file_name", urls.image_file_name(F.col("url")))
    return images.wanted_urls(refs, DEFAULT.but(decorative=("click",)))
