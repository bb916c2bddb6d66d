"""Approximate nearest neighbours: inverted lists scanned in blocks of rotated dimensions, with early abandoning."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.registry import load, query
from quire.llm.scratch import settle

SAMPLE = 20_000  # rows the lists are fitted on, at most
SAMPLE_BYTES = 64 << 20
MOST_LISTS = 1 << 14
PROBES = 0.65  # share of the lists a query looks into; recall 0.96 on vectors without any clusters
BLOCK = 16  # dimensions taken at a time
EPSILON = 2.1  # a candidate goes if its estimated distance exceeds the bound by so many standard errors
PLACE = 4096  # candidates of a list met in one place
ASKED = 2048  # queries met in one place
SCHEMA = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): vectors without null or non-finite parts, not zero, of the most common length; one row an id."""
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & whole)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, size)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def fit_lists(sample: np.ndarray, lists: int, seed: int = 11, rounds: int = 12) -> np.ndarray:
    """Unit centres of spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(sample, len(sample) // 2048 + 1)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norms = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(norms[:, None] > 1e-12, sums / np.maximum(norms, 1e-12)[:, None], centres)
    return centres


def nearest_in_place(ids, vectors, query_ids, queries, rotation, k: int) -> tuple[list, list, list]:
    """The k best of the candidates for each query, by adaptive scanning of rotated dimensions.

    The partial distance over d of D rotated dimensions estimates the whole as D/d times itself; a candidate is abandoned
    when the estimate is over the k-th best distance so far by more than EPSILON/sqrt(d) of it. What is left is scored
    exactly.
    """
    size = vectors.shape[1]
    x, q = _unit(vectors) @ rotation, _unit(queries) @ rotation
    norms, query_norms = np.sqrt((vectors * vectors).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    out_q, out_v, out_s = [], [], []
    seeds = min(len(x), max(64, k + 1))
    for a in range(0, len(q), 64):
        own = q[a : a + 64]
        bound = np.full(len(own), np.inf)
        if seeds > k:  # k-th best of a first few; one more, as the query may be among them
            bound = np.partition(np.maximum(2 - 2 * own @ x[:seeds].T, 0), k, axis=1)[:, k]
        head = slice(0, min(BLOCK, size))
        part = (own[:, head] ** 2).sum(1)[:, None] + (x[:, head] ** 2).sum(1)[None, :] - 2 * own[:, head] @ x[:, head].T
        done = head.stop
        limit = bound * (1 + EPSILON / math.sqrt(done)) ** 2
        row, col = np.nonzero(part * (size / done) <= limit[:, None] + 1e-9)
        apart = part[row, col]
        while done < size and len(row):
            stop = min(done + BLOCK, size)
            for b in range(0, len(row), 1 << 17):
                r, c = row[b : b + (1 << 17)], col[b : b + (1 << 17)]
                apart[b : b + (1 << 17)] += ((own[r, done:stop] - x[c, done:stop]) ** 2).sum(axis=1)
            done = stop
            slack = 1 + (EPSILON / math.sqrt(done) if done < size else 0)
            keep = apart * (size / done) <= bound[row] * slack**2 + 1e-9
            row, col, apart = row[keep], col[keep], apart[keep]
        other = ids[col] != query_ids[a + row]
        row, col = row[other], col[other]
        score = np.zeros(len(row))
        for b in range(0, len(row), 1 << 17):
            r, c = row[b : b + (1 << 17)] + a, col[b : b + (1 << 17)]
            score[b : b + (1 << 17)] = (queries[r] * vectors[c]).sum(axis=1) / (query_norms[r] * norms[c])
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < k
        out_q.append(query_ids[a + row[best]])
        out_v.append(ids[col[best]])
        out_s.append(score[best])
    return out_q, out_v, out_s


def neighbours(
    vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 5, probes: float = PROBES
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` names, the k of the others nearest by cosine that
    were found, nearest first, ties to the smaller id.

    Lists are fitted on a bounded sample by hash order (``SAMPLE`` rows and ``SAMPLE_BYTES``); all rows are in a list, a
    query looks into the nearest ``probes`` of them. A list of many rows or queries is dealt out to a place for every
    ``PLACE`` rows and ``ASKED`` queries, so no place grows with the table. Null, zero and non-finite vectors and those
    of an odd length take no part; ids with several rows take part with the smallest vector; an empty table gives none.
    """
    spark = vectors.sparkSession
    rows = settle(usable(vectors, key, vector), "vectors")
    total = rows.count()
    first = rows.select("v").first()
    size = len(first["v"]) if first else 1
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE, SAMPLE_BYTES // (8 * size))).select("v").toPandas()["v"]
    lists = max(1, min(MOST_LISTS, int(math.sqrt(total)), len(sample)))
    points = _unit(np.stack(sample.to_list())) if len(sample) else np.ones((1, size))
    centres = fit_lists(points, lists)
    rotation = np.linalg.qr(np.random.default_rng(5).normal(size=(size, size)))[0]
    shared = spark.sparkContext.broadcast((centres, rotation))
    looked = max(1, math.ceil(probes * len(centres)))

    def listed(count: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value[0]
            for batch in batches:
                near = -(_unit(_matrix(batch.column("v"), size)) @ own.T) if batch.num_rows else np.zeros((0, len(own)))
                top = np.argsort(near, axis=1, kind="stable")[:, :count]
                lists = pa.ListArray.from_arrays(np.arange(len(top) + 1, dtype=np.int32) * count, pa.array(top.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), lists], ["id", "v", "lists"])

        return run

    schema = "id long, v array<double>, lists array<long>"
    held = settle(rows.mapInArrow(listed(1), schema).select("id", "v", F.get("lists", 0).alias("list")), "lists")
    asked = rows.where(is_query(F.col("id"))).mapInArrow(listed(looked), schema)
    asked = settle(asked.select("id", "v", F.explode("lists").alias("list")), "asked")

    # at most one count a list on either side
    sizes = held.groupBy("list").count().select("list", F.ceil(F.col("count") / PLACE).alias("parts"))
    times = asked.groupBy("list").count().select("list", F.ceil(F.col("count") / ASKED).alias("shares"))
    cells = settle(sizes.join(times, "list"), "cells")

    def placed(df: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(F.lit("place"), "id"), F.col(own))
        all_others = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias("other")
        df = df.join(F.broadcast(cells), "list").select("list", mine.alias("mine"), all_others, "id", "v")
        return df.select("list", F.col("mine" if own == "parts" else "other").alias("part"),
                         F.col("other" if own == "parts" else "mine").alias("share"), "id", "v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        a, b = (t.combine_chunks() for t in (left, right))
        got = nearest_in_place(
            a["id"].to_numpy(), _matrix(a["v"].combine_chunks(), size), b["id"].to_numpy(),
            _matrix(b["v"].combine_chunks(), size), shared.value[1], k,
        )
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, got))))

    place = ["list", "part", "share"]
    candidates, questions = placed(held, "parts", "shares"), placed(asked, "shares", "parts")
    found = candidates.groupBy(*place).cogroup(questions.groupBy(*place)).applyInArrow(meet, SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query("op8_neighbours")
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(load(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)
