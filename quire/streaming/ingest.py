"""The periodic re-run as a stream over newly landed page files, its keyed state kept by Spark."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.operators.content import extract_content, non_empty
from quire.operators.markup_rows import with_title
from quire.operators.page_dates import with_page_date
from quire.operators.regions import skeletons
from quire.plans.build import content_rows, one_page_per_url
from quire.rules import DEFAULT, Rules
from quire.sources.content_store import ContentStore
from quire.sources.pages import PAGE_SCHEMA

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SEEN = "seen"
STATE_SCHEMA = "last_seen timestamp, copies long"
ARRIVAL_SCHEMA = "url string, page_id bigint, file string, first boolean"
BATCH_BITS = 40  # of a first position: the place within a batch; the batch stands above


def parse_batch(pages: DataFrame, rules: Rules = DEFAULT, images: DataFrame | None = None) -> DataFrame:
    """New pages to content rows; the id is the address. Narrow but for the per-address de-duplication."""
    fetched = one_page_per_url(pages.filter(non_empty(F.col("html"))).select("page_id", "url", "html"))
    titled = (
        fetched.withColumn("source", F.col("html"))
        .transform(skeletons, "html", "bare")
        .transform(with_title, "bare", F.col("url"), rules)
        .drop("bare")
    )
    parsed = titled.transform(with_page_date, "source").transform(extract_content, "source", "title", rules, "url")
    return content_rows(parsed.withColumn("doc_id", F.col("url")), images, rules)


class SeenPages(StatefulProcessor):
    """The state of an address: when it was last seen, and how often. A batch's copies of an address come as a stream of
    ids, of which the smallest is kept; what comes out is that one, and whether the address is new."""

    def __init__(self, run_at: dt.datetime):
        self.run_at = run_at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState(SEEN, STATE_SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        chosen, copies = None, 0
        for row in rows:
            own = (row.page_id is None, row.page_id, row.file)
            chosen = own if chosen is None or own < chosen else chosen
            copies += 1
        known = self.seen.get() if self.seen.exists() else None
        self.seen.update((self.run_at, copies + (known[1] if known else 0)))
        yield Row(url=key[0], page_id=chosen[1], file=chosen[2], first=known is None)

    def close(self) -> None:
        pass


class PageIngest:
    """Parses each newly landed page once and keeps registry and content under ``root``.

    What has been seen is state that Spark keeps by address (``transformWithState`` in RocksDB, checkpointed with the
    stream), so a batch reads and writes state for the addresses it brings and nothing else. Only ids pass through the
    state; html is read once, from the batch's own files, for the pages that are new. A batch is written under its own
    number: repeated after a failure it starts from the state before it and writes the same again. An address in many
    copies costs one task their ids. Pages without an address or without html take no part.
    """

    def __init__(self, spark: SparkSession, source: str, root: str, run_at: dt.datetime, rules: Rules = DEFAULT, images: DataFrame | None = None):
        self.spark, self.source, self.root, self.run_at, self.rules, self.images = spark, source, root, run_at, rules, images
        self.content = ContentStore(spark, f"{root}/content")
        self.checkpoint = f"{root}/checkpoint"

    def _process(self, arrivals: DataFrame, batch_id: int) -> None:
        version, path = batch_id + 1, f"{self.root}/arrivals/batch={batch_id:010d}"
        arrivals.write.mode("overwrite").parquet(path)  # the one action on the batch: state is advanced by it
        first = self.spark.read.schema(ARRIVAL_SCHEMA).parquet(path).where("first")
        files = [r["file"] for r in first.select("file").distinct().collect()]  # of one batch, which the driver lists anyway
        pages = self.spark.read.schema(PAGE_SCHEMA).parquet(*files) if files else self.spark.createDataFrame([], PAGE_SCHEMA)
        same = [F.col("p.url") == F.col("f.url"), F.col("p.page_id").eqNullSafe(F.col("f.page_id"))]
        fresh = pages.alias("p").join(first.select("url", "page_id").alias("f"), same, "left_semi")
        self.content.append(parse_batch(fresh, self.rules, self.images), version)

    def state(self) -> DataFrame:
        """(doc_id, last_seen, copies) of every address seen, read from the stream's state."""
        rows = self.spark.read.format("statestore").option("stateVarName", SEEN).load(self.checkpoint)
        return rows.select(F.col("key.url").alias("doc_id"), "value.last_seen", "value.copies")

    def registry(self) -> DataFrame:
        """The registry rows of all pages: what a page says of itself, from its content, and when it was last seen.

        Positions follow the batch in which a page came first, then the page's id.
        """
        batches = self.spark.read.parquet(f"{self.root}/arrivals").where("first")
        position = (F.col("batch").cast("long") * F.lit(1 << BATCH_BITS) + F.coalesce("page_id", F.lit((1 << BATCH_BITS) - 1))).alias("first_pos")
        first = batches.select(F.col("url").alias("doc_id"), position)
        told = self.content.read().select(
            "doc_id", "title", "url", F.col("page_date").alias("date"), F.coalesce("page_raw_date", F.lit("")).alias("raw_date_str")
        )
        rows = told.join(self.state(), "doc_id").join(first, "doc_id")
        return rows.select("doc_id", "title", "url", "date", "raw_date_str", F.lit(False).alias("read"), "last_seen", "first_pos")

    def run(self, max_files_per_batch: int | None = None) -> None:
        """Work through everything that has landed, then stop."""
        reader = self.spark.readStream.schema(PAGE_SCHEMA)
        if max_files_per_batch:
            reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
        landed = reader.parquet(self.source).where(non_empty(F.col("html")) & F.col("url").isNotNull())
        ids = landed.select("url", "page_id", F.col("_metadata.file_path").alias("file"))
        seen = ids.groupBy("url").transformWithState(SeenPages(self.run_at), ARRIVAL_SCHEMA, "Update", "None")
        before = self.spark.conf.get(PROVIDER[0], None)
        self.spark.conf.set(*PROVIDER)
        try:
            stream = (
                seen.writeStream.foreachBatch(self._process)
                .outputMode("update")
                .option("checkpointLocation", self.checkpoint)
                .trigger(availableNow=True)
                .start()
            )
            stream.awaitTermination()
        finally:
            if before is None:
                self.spark.conf.unset(PROVIDER[0])
            else:
                self.spark.conf.set(PROVIDER[0], before)
