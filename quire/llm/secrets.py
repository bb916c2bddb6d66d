"""Secrets in text: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.hashing import slices
from quire.llm.registry import load, query
from quire.llm.segments import maximal_segments

KINDS = ("assign", "access", "hex", "random")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs, so the same as runs of any length of which the short ones are dropped
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1  # class 0 is every other byte
CLASS = np.zeros(256, dtype=np.int64)
CLASS[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, SIZE)
PRIOR = 50.0  # transitions that the prior of each character weighs
LEAST = 12.0  # log-likelihood ratio of a random string, in nats
JOINTS = "/_-=+"  # characters that join strings in a run
SHORTEST = 16  # characters of a run, or of the part of one that no fixed pattern touches


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and then kind."""
    found, low = [], text.lower()
    if any(n in low for n in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _pairs(text: bytes) -> np.ndarray:
    classes = CLASS[np.frombuffer(text, np.uint8)]
    return classes[:-1] * SIZE + classes[1:]


def train(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log-likelihood ratio of each character transition, random against ordinary, from all texts.

    The samples label themselves: values that the fixed patterns find are random strings, all other text is ordinary.
    Transitions are counted in tasks and summed before they reach the driver, ``SIZE`` squared numbers at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SIZE * SIZE), dtype=np.int64)
        for batch in slices(batches, "text"):
            for x in batch.column("text"):
                if not (own := x.as_py()):
                    continue
                sums[1] += np.bincount(_pairs(own.encode("utf-8", "surrogatepass")), minlength=SIZE * SIZE)
                for start, kind, end in base_spans(own):
                    value = own[start:end] if kind else ASSIGN.match(own, start)[2]
                    if value:
                        sums[0] += np.bincount(_pairs(value.encode()), minlength=SIZE * SIZE)
        some = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[0, some]), pa.array(sums[1, some])], ["pair", "random", "all"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(run, "pair long, random long, all long")
    rows = counted.groupBy("pair").agg(F.sum("random").alias("random"), F.sum("all").alias("all")).collect()
    sums = np.zeros((2, SIZE * SIZE))
    for r in rows:
        sums[:, r["pair"]] = r["random"], max(r["all"] - r["random"], 0)
    inside = sums.reshape(2, SIZE, SIZE)[:, 1:, 1:]
    alone = inside.sum(axis=1, keepdims=True) + 0.5
    prior = PRIOR * alone / alone.sum(axis=2, keepdims=True)  # a transition rarely seen is as likely as its second character
    rates = np.zeros((2, SIZE, SIZE))
    rates[:, 1:, 1:] = np.log((inside + prior) / (inside.sum(axis=2, keepdims=True) + PRIOR))
    return (rates[0] - rates[1]).reshape(-1)


def segments(scores: np.ndarray, least: float = LEAST) -> list[tuple[int, int]]:
    """(start, end) of all maximal scoring segments of ``scores`` that reach ``least``, by start."""
    return [(a, b) for a, b, score in maximal_segments(scores.tolist()) if score >= least]


def covered(base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The places that the fixed patterns cover, as ranges apart from each other."""
    ranges: list[tuple[int, int]] = []
    for a, _, b in base:  # by start
        if ranges and a <= ranges[-1][1]:
            ranges[-1] = ranges[-1][0], max(b, ranges[-1][1])
        else:
            ranges.append((a, b))
    return ranges


def random_parts(text: str, base: list[tuple[int, int, int]], table: np.ndarray, least: float = LEAST) -> list[tuple[int, int]]:
    """(start, end) of the random strings of a text, by start.

    Of each run of ``SHORTEST`` or more identifier characters, less what the fixed patterns cover, it is the whole part
    if its summed ratio reaches ``least``, else each maximal segment that does, widened to the next ``JOINTS``.
    """
    found, taken, k = [], covered(base), 0
    for m in RUN.finditer(text):
        at, parts = m.start(), []
        while k < len(taken) and taken[k][0] < m.end():
            if taken[k][1] > at:
                parts.append((at, taken[k][0]))
                at = taken[k][1]
            if taken[k][1] >= m.end():
                break  # may reach into the next run
            k += 1
        parts.append((at, m.end()))
        for a, b in parts:
            if b - a < SHORTEST:
                continue
            scores = table[_pairs(text[a:b].encode())]
            if scores.sum() >= least:
                found.append((a, b))
            elif scores[scores > 0].sum() >= least:
                for x, y in segments(scores, least):
                    x, y = a + x, a + y + 1  # a transition ends one further
                    while x > a and text[x - 1] not in JOINTS:
                        x -= 1
                    while y < b and text[y] not in JOINTS:
                        y += 1
                    if found and x < found[-1][1]:
                        x, y = found[-1][0], max(y, found[-1][1])
                        found.pop()
                    found.append((x, y))
    return found


def secrets(docs: DataFrame, ratio: np.ndarray, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(key, spans, added): spans are (kind, start, end) by start and then kind, in characters; added, how many of them
    the models found.

    The models judge runs of 16 or more identifier characters, their maximal scoring segments, and what fixed patterns
    leave of a run if that is as long. Null and empty texts have none. Repeated rows and null keys stay. An empty table gives none. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    fields = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in slices(batches, "text"):
            spans, added = [], []
            for x in batch.column("text"):
                own = x.as_py() or ""
                base = base_spans(own)
                more = [(a, 3, b) for a, b in random_parts(own, base, table, least)]
                spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(base + more)])
                added.append(len(more))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(spans, fields), pa.array(added, pa.int64())], ["key", "spans", "added"]
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = f"key {kind}, spans array<struct<kind:string,start:int,end:int>>, added long"
    return rows.mapInArrow(run, out).withColumnRenamed("key", key)


@query("op9_secrets")
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = secrets(docs, train(docs))
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])

    def told(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [F.size(F.filter("spans", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def _of(kind: str):
    return lambda s: s["kind"] == kind
