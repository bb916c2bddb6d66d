"""Only new pages are parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.urls import safe_key

MODES = ("normal", "rebuild", "force")


def build_mode(rebuild: bool = False, force_refresh: bool = False) -> str:
    """A forced refresh cancels a rebuild."""
    return "force" if force_refresh else "rebuild" if rebuild else "normal"


def is_stored(docs: DataFrame, content: DataFrame, key: str = "doc_id") -> DataFrame:
    """SRC5: documents that already have content."""
    return docs.join(content.select(key), key, "left_semi")


def missing(docs: DataFrame, content: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents without content.

    Two steps: the anti-join runs on keys alone, then the wide rows are kept by a semi-join with the missing keys. The
    page text crosses the network only in the second step, where Spark can broadcast the keys if they are few (measured
    at run time) or filter by a Bloom filter before the shuffle. Tables bucketed by the key need no shuffle in either.
    """
    keys = docs.select(key).join(content.select(key), key, "left_anti")
    return docs.join(keys, key, "left_semi")


def stored(docs: DataFrame, content: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents joined to their content; those without are skipped."""
    return docs.join(content, key)


def merged(content: DataFrame, new: DataFrame) -> DataFrame:
    """Content on hand plus the newly parsed rows, with where each row comes from."""
    return content.withColumn("origin", F.lit("cached")).unionByName(new.withColumn("origin", F.lit("fetched")))


def replaced(content: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """SNK2: rows of ``new`` take the place of rows with the same key."""
    return content.join(new.select(key), key, "left_anti").unionByName(new)


def latest_per_key(content: DataFrame, version: str, key: str = "doc_id") -> DataFrame:
    """SNK2: the row of the highest version per key; only keys and versions are aggregated, rows stay put until then."""
    newest = content.groupBy(key).agg(F.max(version).alias(version))
    return content.join(newest, [key, version], "left_semi")


def content_key(doc_id: Column) -> Column:
    """The key content is stored under."""
    return safe_key(doc_id)


def stats(content: DataFrame, column: str = "content_html") -> DataFrame:
    """Entries, bytes and MB (half-even rounding to 2 digits)."""
    total = F.coalesce(F.sum(F.octet_length(column).cast("bigint")), F.lit(0).cast("bigint"))
    return content.agg(F.count(F.lit(1)).alias("entries"), total.alias("bytes")).withColumn(
        "mb", F.bround(F.col("bytes") / F.lit(1048576.0), 2)
    )


def origin_counts(rows: DataFrame) -> DataFrame:
    """N5"""
    return rows.groupBy("origin").agg(F.count(F.lit(1)).alias("n_docs"))


def listed_in_registry(listing: DataFrame, registry: DataFrame, key: str = "doc_id") -> DataFrame:
    """The listing's documents with their registry rows; unknown ones are skipped, repeats stay."""
    return listing.select(key, *[c for c in listing.columns if c not in registry.columns]).join(registry, key)
