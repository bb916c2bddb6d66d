"""Parsed content (SRC4, SRC5, SNK2, SNK3, N4): append-only batches of Parquet in generations.

A batch adds only documents that had no content, so a generation never holds a key twice and reading needs no shuffle.
A forced refresh or a clear starts a new generation. Batches are directories named by their number and count once
complete, so a repeated batch is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import plain_base64
from quire.sources.key_lookup import narrowed
from quire.sources.versioned import VersionedTable

SCHEMA = (
    "doc_id string, url string, title string, safe_key string, content_html string, n_chars int, page_date string, page_raw_date string, "
    "images array<struct<filename:string,data:binary>>"
)
JSON_SCHEMA = "essay_id string, content_html string, images array<struct<filename:string,data:string>>"


class ContentStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._generations = VersionedTable(spark, f"{self.root}/generations", "started_by string")

    def generation(self) -> int:
        known = self._generations.versions()
        return known[-1] if known else 0

    def _batches(self) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/g={self.generation():06d}", SCHEMA, "doc_id")

    def batches(self) -> list[int]:
        return self._batches().versions()

    def read(self) -> DataFrame:
        """SRC4: all content of the current generation."""
        table = self._batches()
        paths = [table.path_of(v) for v in table.versions()]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*paths)

    def read_for(self, docs: DataFrame) -> DataFrame:
        """SRC5, N1: content to join with ``docs`` by doc_id; for a few documents most row groups are skipped."""
        return narrowed(self.read(), docs)

    def append(self, rows: DataFrame, batch: int | None = None) -> int:
        """SNK2: add a batch of documents without content so far."""
        return self._batches().write(rows, batch)

    def new_generation(self, started_by: str) -> int:
        """N3/SNK3: later reads start from nothing; returns how many documents the old generation held."""
        n_rows = self.read().count()
        self._generations.write(self.spark.createDataFrame([(started_by,)], "started_by string"))
        return n_rows


def read_json_entries(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: interchange entries, one JSON object per file; unreadable files give no row (a miss)."""
    raw = spark.read.text(path, wholetext=True)
    entry = F.from_json("value", JSON_SCHEMA)
    rows = raw.select(entry.alias("e")).filter("e.essay_id is not null and e.content_html is not null")
    images = F.transform(
        F.coalesce("e.images", F.array().cast("array<struct<filename:string,data:string>>")),
        lambda i: F.struct(i["filename"].alias("filename"), F.unbase64(i["data"]).alias("data")),
    )
    return rows.select(F.col("e.essay_id").alias("doc_id"), F.col("e.content_html").alias("content_html"), images.alias("images"))


def json_entries(content: DataFrame) -> DataFrame:
    """SNK2/I9: content rows in the interchange layout, image bytes in base64."""
    images = F.transform(
        "images", lambda i: F.struct(i["filename"].alias("filename"), plain_base64(i["data"]).alias("data"))
    )
    return content.select(F.col("doc_id").alias("essay_id"), "content_html", images.alias("images"))


def write_json_entries(content: DataFrame, path: str) -> None:
    """SNK2: interchange entries as JSON lines."""
    json_entries(content).write.mode("overwrite").json(path)


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """N4 over files: entries, bytes, MB; file contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("length")
    total = F.coalesce(F.sum("length"), F.lit(0).cast("bigint"))
    return files.agg(F.count(F.lit(1)).alias("entries"), total.alias("bytes")).withColumn(
        "mb", F.bround(F.col("bytes") / F.lit(1048576.0), 2)
    )
