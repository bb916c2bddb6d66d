"""SimHash near-duplicates: bit-sliced comparison inside multi-index buckets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bitplanes import close_pairs
from quire.llm.components import components
from quire.llm.hashing import shingle_hashes, simhash, slices
from quire.llm.registry import load, query
from quire.llm.scratch import settle

CELL = 4096  # rows of a bucket compared in one place; larger buckets are dealt out to pairs of parts
LOAD = 512  # rows a bucket should have on average
RADIUS = 4


def fingerprints(docs: DataFrame, key: str, text: str, size: int = 4, lanes: int = 1) -> DataFrame:
    """(key, p0, p1, ...): a SimHash of 64 bits a lane over word shingles of whole texts; null and empty texts give zero."""
    names = [f"p{i}" for i in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            prints = np.zeros((batch.num_rows, lanes), dtype=np.uint64)
            for i, x in enumerate(batch.column("text")):
                prints[i] = simhash(shingle_hashes(x.as_py(), size), lanes)
            longs = prints.view(np.int64)
            columns = [batch.column("key"), *[pa.array(longs[:, i]) for i in range(lanes)]]
            yield pa.RecordBatch.from_arrays(columns, ["key", *names])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    out = ", ".join([f"key {kind}", *[f"{n} long" for n in names]])
    return rows.mapInArrow(run, out).withColumnRenamed("key", key)


def multi_index(radius: int, rows: int) -> list[tuple[int, ...]]:
    """Masks such that fingerprints within the radius agree under at least one of them.

    With b blocks, at most ``radius`` differ, so some choice of b - radius blocks agrees. More blocks give longer keys;
    b follows the number of fingerprints, so that a bucket has ``LOAD`` of them on average if they are spread evenly.
    """
    b = next(b for b in range(radius + 1, 65) if rows / 2 ** (64 * (b - radius) / b) <= LOAD or b == radius + 5)
    edges = [64 * i // b for i in range(b + 1)]
    blocks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(b)]
    return [(sum(some),) for some in combinations(blocks, b - radius)]


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def close_links(prints: DataFrame, radius: int, masks: list[tuple[int, ...]]) -> DataFrame:
    """(a, b) of nodes whose fingerprints differ in at most ``radius`` bits, enough to connect all such nodes of a bucket.

    ``prints`` has node (long) and p0, p1, ... Buckets are equal bits under a mask. A bucket over ``CELL`` rows is dealt
    out to one place for every pair of its parts, so each pair of rows meets somewhere and no place holds more than about
    two parts. A place finds all its close pairs and returns a spanning forest of them, not the pairs.
    """
    lanes = sum(c.startswith("p") and c[1:].isdigit() for c in prints.columns)
    names = [f"p{i}" for i in range(lanes)]

    def bucket(t: int, mask: tuple[int, ...]):
        own = [F.col(n).bitwiseAND(F.lit(_signed(m))) for n, m in zip(names, mask)]
        return F.struct(F.lit(t).alias("t"), (own[0] if lanes == 1 else F.xxhash64(*own)).alias("bucket"))

    entries = prints.select("node", *names, F.inline(F.array(*[bucket(t, m) for t, m in enumerate(masks)])))
    hot = entries.groupBy("t", "bucket").count().where(F.col("count") > CELL)
    entries = entries.join(hot, ["t", "bucket"], "left")
    parts = F.ceil(F.coalesce("count", F.lit(1)) / CELL).cast("long")
    own = F.pmod(F.xxhash64(F.lit("part"), "node"), F.col("parts"))
    places = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
        lambda other: F.least(F.col("own"), other) * F.col("parts") + F.greatest(F.col("own"), other),
    )
    entries = entries.withColumn("parts", parts).withColumn("own", own)
    entries = entries.select("t", "bucket", F.explode(places).alias("place"), "node", *names)
    entries = entries.repartition("t", "bucket", "place").sortWithinPartitions("t", "bucket", "place")

    def compare(rows: pa.Table) -> pa.RecordBatch:
        cols = {c: rows.column(c).to_numpy() for c in ("t", "bucket", "place", "node", *names)}
        n, nodes = rows.num_rows, cols["node"]
        new = np.zeros(n, dtype=bool)
        for c in ("t", "bucket", "place"):
            new[1:] |= cols[c][1:] != cols[c][:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts, n)[np.searchsorted(starts, np.arange(n), side="right")]
        labels, prints, a, b = np.arange(n), np.stack([cols[c] for c in names], axis=1).view(np.uint64), [], []
        for i, j in close_pairs(prints, ends, radius):
            for x, y in zip(*(v[labels[i] != labels[j]].tolist() for v in (i, j))):
                low, high = sorted((_root(labels, x), _root(labels, y)))
                if low != high:
                    labels[high] = low
                    a.append(x)
                    b.append(y)
            while not np.array_equal(flat := labels[labels], labels):
                labels = flat
        x, y = (nodes[np.array(v, dtype=np.int64)] for v in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) < 8 * CELL:
                continue
            rows = pa.Table.from_batches(held)
            last = [rows.column(c)[-1].as_py() for c in ("t", "bucket", "place")]
            same = np.ones(rows.num_rows, dtype=bool)
            for c, x in zip(("t", "bucket", "place"), last):
                same &= rows.column(c).to_numpy() == x
            cut = rows.num_rows - int(same.sum())  # the last bucket may go on in the next batch
            if cut:
                yield compare(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
        if held:
            yield compare(pa.Table.from_batches(held))

    return entries.mapInArrow(run, "a long, b long").distinct()


def _root(labels: np.ndarray, x: int) -> int:
    while labels[x] != x:
        x = labels[x]
    return x


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint, component_id) of every row: components of fingerprints within ``radius`` bits.

    The key is an integer. Equal fingerprints are compared once, as the smallest key that has them, so exact copies cost
    nothing more. Null and empty texts have fingerprint zero and are linked like any other. Repeated rows stay repeated.
    Null keys keep their row and get the component of their fingerprint, null if no other key has it or one near it.
    An empty table gives none. Other columns are not looked at.
    """
    prints = settle(fingerprints(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), "key", "text", size), "prints")
    nodes = settle(prints.groupBy("p0").agg(F.min("key").alias("node")).where("node IS NOT NULL"), "nodes")
    links = close_links(nodes, radius, multi_index(radius, nodes.count()))
    found = components(links)
    classes = nodes.join(found, "node", "left").select(
        F.col("p0").alias("p"), F.coalesce("component", "node").alias("component_id")
    )
    return prints.join(classes, prints["p0"] == classes["p"], "left").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("p0"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op1_near_copies")
def op1_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(load(spark, sf_dir, "documents"))
