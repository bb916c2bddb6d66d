"""Keyed tables in hash partitions: an update rewrites the partitions of the keys it brings, and no other (M1, M2, M3)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import registry
from quire.rules import DEFAULT, Rules
from quire.sources.key_lookup import is_one_of, with_key_filter

PART = "part"


class HashedTable:
    """Rows unique on ``key`` under ``root``, in ``parts`` folders by the hash of the key.

    ``parts`` is fixed for a table; it bounds what an update of a few keys reads and writes to about a ``parts``-th each,
    and what the driver learns of an update to that many numbers. Writes replace whole partitions (dynamic partition
    overwrite): files of a partition are swapped when all are written, so a job that loses executors repeats tasks, and
    one that dies before leaves the table as it was. Updates by key are the same when repeated.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "doc_id", parts: int = 64):
        self.spark, self.root, self.schema, self.key, self.parts = spark, root.rstrip("/"), schema, key, parts
        self.columns = spark.createDataFrame([], schema).columns

    def _part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def _stored(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return self.spark.createDataFrame([], f"{self.schema}, {PART} int")
        return self.spark.read.schema(f"{self.schema}, {PART} int").parquet(self.root)

    def read(self) -> DataFrame:
        return self._stored().select(*self.columns)

    def get(self, keys: list) -> DataFrame:
        """M5: the rows of a few keys; other partitions are not listed, and other row groups not read."""
        parts = self.spark.range(1).select(F.array_distinct(F.transform(F.array(*map(F.lit, keys)), self._part))).first()[0]
        return self._stored().where(F.col(PART).isin(parts) & is_one_of(F.col(self.key), keys)).select(*self.columns)

    def _write(self, rows: DataFrame) -> None:
        placed = rows.select(*self.columns).withColumn(PART, self._part(F.col(self.key)))
        # one task, and so one file, for a partition; AQE splits or joins none of them
        placed = placed.repartition(self.parts, PART).sortWithinPartitions(PART, self.key)
        writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART)
        with_key_filter(writer, self.key).parquet(self.root)

    def replace(self, rows: DataFrame) -> None:
        """Write all rows; partitions without any stay as they are, so this is for a new table."""
        self._write(rows)

    def update(self, source: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Write ``merge(rows of the touched partitions, source)``; returns the touched partitions.

        ``source`` is read twice, so it should be a stored table; only its keys are, the first time.
        """
        touched = [r[PART] for r in source.select(self._part(F.col(self.key)).alias(PART)).distinct().collect()]
        if touched:
            known = self._stored().where(F.col(PART).isin(touched)).select(*self.columns)
            self._write(merge(known, source))
        return sorted(touched)


class Registry(HashedTable):
    """The document registry as a hashed table."""

    def __init__(self, spark: SparkSession, root: str, parts: int = 64):
        super().__init__(spark, root, registry.SCHEMA, "doc_id", parts)

    def upsert(self, source: DataFrame, seen_at: dt.datetime, rules: Rules = DEFAULT, order: str = "pos") -> list[int]:
        """M1: ``registry.upsert`` of the touched partitions. Of the others only the positions are looked at, for the
        place of new documents."""
        everything = self.read()
        return self.update(source, lambda known, new: registry.upsert(known, new, seen_at, rules, order, all_rows=everything))

    def mark(self, ids: DataFrame, read: bool) -> list[int]:
        """M2, M3: set the read flag of the given ids (column ``doc_id``)."""
        return self.update(ids, registry.mark_read if read else registry.mark_unread)
