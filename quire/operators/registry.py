"""The document registry: upserts, read flags, searches, listings.

A registry is a DataFrame unique on ``doc_id`` with the columns of ``SCHEMA``; updates return a new one.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.arrays import strings
from quire.functions.dates import display_date
from quire.operators.ranking import Key
from quire.rules import DEFAULT, Rules

SCHEMA = (
    "doc_id string, title string, url string, date string, raw_date_str string, read boolean, "
    "last_seen timestamp, first_pos bigint"
)


def empty_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def last_per_document(source: DataFrame, order: str = "pos") -> DataFrame:
    """Fold repeated source rows of one id: the last non-null value of each field, the first position.

    Partially aggregated, so an id repeated in a third of all rows is one row per task in the shuffle.
    """
    def latest(name: str) -> Column:
        # One order for all fields, also where positions repeat, so that they come from one row.
        ordered = F.struct(F.col(order).alias("at"), F.col("url").alias("u"), F.col("title").alias("t"), F.col(name).alias("v"))
        return F.max(F.when(F.col(name).isNotNull(), ordered))["v"].alias(name)

    read = latest("read") if "read" in source.columns else F.lit(None).cast("boolean").alias("read")
    return source.groupBy("doc_id").agg(
        latest("title"), latest("url"), latest("date"), latest("raw_date_str"), read, F.min(order).alias("first_pos")
    )


def upsert(
    registry: DataFrame, source: DataFrame, seen_at: dt.datetime, rules: Rules = DEFAULT, order: str = "pos",
    all_rows: DataFrame | None = None,
) -> DataFrame:
    """M1: new ids are added unread, known ones get the source's title and url, and its date, raw date and read flag
    where not null.

    An empty raw date means "none" and keeps the known one; with ``compat`` it overwrites. New documents follow the
    known ones in ``first_pos`` order; ``all_rows`` is the whole registry where ``registry`` is only a part of it.
    """
    if not rules.compat:
        source = source.withColumn("raw_date_str", F.nullif("raw_date_str", F.lit("")))
    latest = last_per_document(source, order).alias("s")
    known = registry.alias("t")
    # Positions of new rows continue after the known ones.
    offset = (registry if all_rows is None else all_rows).agg(F.coalesce(F.max("first_pos"), F.lit(-1)) + 1).scalar()
    joined = known.join(latest, F.col("t.doc_id") == F.col("s.doc_id"), "full_outer")

    def prefer_source(name: str) -> Column:
        return F.coalesce(F.col(f"s.{name}"), F.col(f"t.{name}")).alias(name)

    seen = F.col("s.doc_id").isNotNull()
    raw = prefer_source("raw_date_str")
    if not rules.compat:
        # A new document without a raw date carries the empty string, as the index says.
        raw = F.coalesce(F.col("s.raw_date_str"), F.col("t.raw_date_str"), F.lit("")).alias("raw_date_str")
        raw = F.when(seen, raw).otherwise(F.col("t.raw_date_str")).alias("raw_date_str")
    return joined.select(
        prefer_source("doc_id"),
        prefer_source("title"),
        prefer_source("url"),
        prefer_source("date"),
        raw,
        F.coalesce("s.read", "t.read", F.lit(False)).alias("read"),
        F.when(seen, F.lit(seen_at).cast("timestamp")).otherwise(F.col("t.last_seen")).alias("last_seen"),
        F.coalesce("t.first_pos", F.col("s.first_pos") + offset).cast("bigint").alias("first_pos"),
    )


def _marked(registry: DataFrame, ids: DataFrame, value: bool) -> DataFrame:
    hits = ids.select(F.col("doc_id").alias("__hit")).distinct()
    joined = registry.join(hits, F.col("doc_id") == F.col("__hit"), "left")
    flag = F.when(F.col("__hit").isNotNull(), F.lit(value)).otherwise(F.col("read"))
    return joined.withColumn("read", flag).drop("__hit")


def mark_read(registry: DataFrame, ids: DataFrame) -> DataFrame:
    """M2: the registry with the given ids (column ``doc_id``) read."""
    return _marked(registry, ids, True)


def mark_unread(registry: DataFrame, ids: DataFrame) -> DataFrame:
    """M3"""
    return _marked(registry, ids, False)


def marked_count(registry: DataFrame, ids: DataFrame) -> DataFrame:
    """M2/M3: how many of the given ids exist; repeats count each time."""
    return ids.join(registry.select("doc_id"), "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("n_marked"))


def title_contains(title: Column, query: str) -> Column:
    """M4: case-insensitive substring; '%' and '_' are ordinary characters."""
    return F.contains(F.lower(title), F.lower(F.lit(query)))


def find_by_title(registry: DataFrame, query: str) -> DataFrame:
    """M4"""
    return registry.filter(title_contains(F.col("title"), query)).select("doc_id")


def get_document(registry: DataFrame, doc_id: str) -> DataFrame:
    """M5: pushed down to the scan."""
    return registry.filter(F.col("doc_id") == doc_id)


def all_documents(registry: DataFrame) -> DataFrame:
    """M6: in insertion order."""
    return registry.orderBy("first_pos")


def unread_documents(registry: DataFrame) -> DataFrame:
    """M7"""
    return registry.filter(~F.col("read"))


def read_documents(registry: DataFrame) -> DataFrame:
    """M8"""
    return registry.filter(F.col("read"))


def title_matches(registry: DataFrame, queries: list[str]) -> DataFrame:
    """M9: (query, doc_id, title) for every hit of a list of queries.

    The list is an argument, so the matching queries are picked inside each row: no join and no broadcast. Repeated
    queries count once.
    """
    hits = F.filter(strings(list(dict.fromkeys(queries))), lambda q: F.contains(F.lower(F.col("title")), F.lower(q)))
    return registry.select(F.explode(hits).alias("query"), "doc_id", "title")


def match_report(registry: DataFrame, queries: list[str]) -> DataFrame:
    """M9: (query, n_hits), 0 for queries without a hit. The aggregate has one row per query."""
    counts = title_matches(registry, queries).groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    asked = registry.sparkSession.range(1).select(F.explode(strings(list(dict.fromkeys(queries)))).alias("query"))
    return asked.join(counts, "query", "left").select("query", F.coalesce("n", F.lit(0)).alias("n_hits"))


def target_ids(registry: DataFrame, ids: list[str] = (), title_queries: list[str] = ()) -> DataFrame:
    """Distinct explicit ids and ids found by title; asking for neither is an error."""
    if not ids and not title_queries:
        raise ValueError("no documents specified: give ids or title queries")
    explicit = registry.sparkSession.range(1).select(F.explode(strings(list(ids))).alias("doc_id"))
    return explicit.unionByName(title_matches(registry, list(title_queries)).select("doc_id")).distinct()


def marked_titles(registry: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids and titles of the marked documents; unknown ids are left out."""
    return ids.join(registry.select("doc_id", "title"), "doc_id")


def listed(registry: DataFrame, unread_only: bool = False, read_only: bool = False) -> DataFrame:
    """Unread wins when both are asked for."""
    if unread_only:
        return unread_documents(registry)
    return read_documents(registry) if read_only else registry


def listing_keys() -> list[Key]:
    """The whole key descending, so undated documents come first."""
    date = F.nullif(F.col("date"), F.lit(""))
    return [Key(date.isNull(), True), Key(date, True), Key(F.col("title"), True), Key(F.col("first_pos"))]


def listing_order() -> list[Column]:
    """M13 as sort columns."""
    return [k.column() for k in listing_keys()]


def listing_row() -> Column:
    """Status, title cut or padded to 50, date padded to 15, id."""
    status = F.when(F.col("read"), "[READ]  ").otherwise("[UNREAD]")
    shown = display_date(F.col("raw_date_str"), F.col("date"))
    padded = F.when(F.length(shown) < 15, F.rpad(shown, 15, " ")).otherwise(shown)
    return F.concat(status, F.lit(" "), F.rpad("title", 50, " "), F.lit(" | "), padded, F.lit(" | "), "doc_id")


def listing(registry: DataFrame, unread_only: bool = False, read_only: bool = False) -> DataFrame:
    """The listing lines in order; a range shuffle, nothing collected."""
    rows = listed(registry, unread_only, read_only).orderBy(*listing_order())
    return rows.select("doc_id", listing_row().alias("line"))


def counts(registry: DataFrame) -> DataFrame:
    """Total, unread and read of the listed rows."""
    return registry.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("read")).alias("unread"),
        F.count_if(F.col("read")).alias("read"),
    )
