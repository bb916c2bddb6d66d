"""Registration of named queries and shared SQL pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where there is one, the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- SQL side ------------------------------------------------------------------------------------------------

_REST = """[^>"'']*(?:(?:"[^"]*"|''[^'']*'')[^>"'']*)*>"""
_DROPPED = r"!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>|[!?][^>]*>"
SQL_TOKEN = rf"'(?is)<(?:{_DROPPED}|/?[a-z]{_REST})|[^<]+|<'"
SQL_SKELETON = rf"'(?is)<(?:{_DROPPED}|(/?[a-z][a-z0-9:-]*){_REST})|[\x01\x02]'"


def sql_decode(column: str) -> str:
    """The entities that occur in the driver pages; the ampersand last."""
    return (
        f"replace(replace(replace(replace({column}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"
    )


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_strip(column: str) -> str:
    return rf"regexp_replace({column}, '^\s+|\s+$', '', 'g')"


def sql_skeleton(column: str = "html") -> str:
    return sql_decode(rf"regexp_replace({column}, {SQL_SKELETON}, chr(1) || '\1' || chr(2), 'g')")


def sql_tokens(source: str = "pages", key: str = "page_id", html: str = "html") -> str:
    """CTE body: (key, pos, token, tag, kind, text)."""
    return rf"""
      SELECT {key}, pos, token, tag, kind, CASE WHEN kind = 'text' THEN {sql_decode('token')} END AS text FROM (
        SELECT *, CASE WHEN token LIKE '</%' AND tag <> '' THEN 'close'
                       WHEN regexp_matches(token, '(?is)^<(?:[!?].|script\b.*</script|style\b.*</style)') THEN 'skip'
                       WHEN tag IN ('area','base','br','col','embed','hr','img','input','link','meta','source','track','wbr') THEN 'void'
                       WHEN tag <> '' THEN 'open' ELSE 'text' END AS kind
        FROM (SELECT {key}, pos, token, lower(regexp_extract(token, '^</?([A-Za-z][A-Za-z0-9:-]*)', 1)) AS tag
              FROM (SELECT {key}, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos
                    FROM (SELECT {key}, regexp_extract_all({html}, {SQL_TOKEN}) AS toks FROM {source}))))
      WHERE kind <> 'skip'"""


# A registry over documents, labels and orders; both sides build it by the same rule.
REGISTRY_SQL = """
  SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, split_part(d.text, chr(10), 1) AS title, 'https://example.org/' || d.source AS url,
         CASE WHEN o.o_orderstatus = 'P' THEN NULL ELSE strftime(o.o_orderdate, '%Y-%m-01') END AS date,
         CASE o.o_orderstatus WHEN 'F' THEN strftime(o.o_orderdate, '%B %Y') WHEN 'O' THEN '' END AS raw_date_str,
         coalesce(l.quality, 0) = 1 AS read, d.doc_id AS first_pos
  FROM documents d LEFT JOIN orders o ON o.o_orderkey = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id"""


def registry_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, orders = (load(spark, sf_dir, t) for t in ("documents", "labels", "orders"))
    # titles are cut before the joins, so that texts do not travel
    docs = docs.select("doc_id", "source", F.substring_index("text", "\n", 1).alias("title"))
    joined = docs.join(orders, docs.doc_id == orders.o_orderkey, "left").join(
        labels.select(F.col("doc_id").alias("l_id"), "quality"), docs.doc_id == F.col("l_id"), "left"
    )
    status, day = F.col("o_orderstatus"), F.col("o_orderdate")
    return joined.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        "title",
        F.concat(F.lit("https://example.org/"), "source").alias("url"),
        F.when(status != "P", F.date_format(day, "yyyy-MM-01")).alias("date"),
        F.when(status == "F", F.date_format(day, "MMMM yyyy")).when(status == "O", "").alias("raw_date_str"),
        (F.coalesce(F.col("quality"), F.lit(0)) == 1).alias("read"),
        F.lit(None).cast("timestamp").alias("last_seen"),
        F.col("doc_id").alias("first_pos"),
    )


def stored_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content on hand: the labelled documents."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return docs.join(labels.select("doc_id"), "doc_id", "left_semi").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content_html")
    )


CONTENT_SQL = """
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS content_html FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels)"""
