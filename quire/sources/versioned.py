"""Tables replaced as a whole: each write is a new version directory, readers take the newest complete one.

A version counts only once its ``_SUCCESS`` marker is there, which Spark's committer writes last, so a job that dies or
loses executors half-way leaves the previous version current. Nothing is deleted or overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.sources.key_lookup import with_key_filter


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, schema: str, key: str | None = None):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        fs, path = self._files()
        if not fs.exists(path):
            return []
        make_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        found = []
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if name.startswith("v=") and fs.exists(make_path(status.getPath(), "_SUCCESS")):
                found.append(int(name[2:]))
        return sorted(found)

    def path_of(self, version: int) -> str:
        return f"{self.root}/v={version:010d}"

    def read(self, version: int | None = None) -> DataFrame:
        """The current (or a given) version; an empty table before the first write."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path_of(version if version is not None else known[-1]))

    def write(self, df: DataFrame, version: int | None = None, partition_by: tuple[str, ...] = ()) -> int:
        """Write the next version, or a given one: repeating a batch under its own number is harmless."""
        known = self.versions()
        target = version if version is not None else (known[-1] + 1 if known else 1)
        if target in known:
            return target
        columns = self.spark.createDataFrame([], self.schema).columns
        writer = df.select(*columns).write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        if self.key:
            writer = with_key_filter(writer, self.key)
        writer.parquet(self.path_of(target))
        return target

    def clear(self) -> int:
        """SNK3/SNK5: make an empty version current; returns how many rows the old one had."""
        n_rows = self.read().count()
        self.write(self.spark.createDataFrame([], self.schema))
        return n_rows
