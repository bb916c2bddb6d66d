"""Packing of token sequences: shortest-pack-first over the length histogram, joined back by rank."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.byte_bpe import byte_bpe
from quire.llm.hashing import slices
from quire.llm.registry import load, query
from quire.llm.scratch import settle

LENGTH = 1024
END_ID = 0
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
RANKED_ROWS = 20_000  # pieces of one length numbered in one task


def pack_histogram(counts: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of piece lengths and how many sequences have each, for ``counts[n]`` pieces of length n.

    Lengths go longest first, each into the shortest pack that has room; as many packs as possible are extended at once,
    so the work follows the number of lengths and patterns, not of pieces.
    """
    open_packs: dict[int, list[list]] = defaultdict(list)  # room left -> [pattern, count]
    for n in sorted(counts, reverse=True):
        left, room = counts[n], length
        while left:
            room = min(room, length - n)
            while room >= n and not open_packs.get(room):
                room -= 1
            if room < n:
                open_packs[length - n].append([(n,), left])
                break
            pattern, count = open_packs[room].pop()
            used = min(count, left)
            if used < count:
                open_packs[room].append([pattern, count - used])
            open_packs[room - n].append([(*pattern, n), used])
            left -= used
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for packs in open_packs.values():
        for pattern, count in packs:
            merged[pattern] += count
    return sorted(merged.items(), reverse=True)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first sequence_id, offset) of its slots, by rank."""
    out: dict[int, list] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    base = 0
    for pattern, count in patterns:
        offset = 0
        for n in pattern:
            out[n].append((taken[n], base, offset))
            taken[n] += count
            offset += n
        base += count
    return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


def token_pieces(docs: DataFrame, key: str, text: str, length: int, tokenizer_file: str, ranks_file: str) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens): each document's ids and an end id, cut every ``length`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = byte_bpe(tokenizer_file, ranks_file), np.array([END_ID], dtype="<u4")
        for batch in slices(batches, "text"):
            rows, starts, lengths, sums, totals = [], [], [], [], []
            for i, ids in enumerate(coder.encode(batch.column("text"))):
                ids = np.concatenate([ids.astype("<u4"), end])
                for a in range(0, len(ids), length):
                    piece = ids[a : a + length]
                    rows.append(i)
                    starts.append(a)
                    lengths.append(len(piece))
                    sums.append(zlib.crc32(piece.tobytes()))
                    totals.append(len(ids))
            longs = [pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]
            keys = batch.column("key").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *longs], ["key", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def ranked(pieces: DataFrame, order: list[str], counts: dict[int, int], share: int = RANKED_ROWS) -> DataFrame:
    """Number the pieces of each length from 0 (column rank), many tasks sharing a length of many pieces.

    A length is dealt out by hash to one part for every ``share`` pieces; parts are numbered inside and shifted by the
    sizes of the parts before them, which are counted first.
    """
    parts = [counts.get(n, 0) // share + 1 for n in range(max(counts, default=0) + 1)]
    of = F.get(F.array(*map(F.lit, parts)), F.col("length").cast("int"))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64(*order), of.cast("long")))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.groupBy("length", "part").count()
    shifts = sizes.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("length", "part").orderBy(*order)
    numbered = pieces.withColumn("inside", F.row_number().over(inside) - 1)
    return numbered.join(shifts, ["length", "part"]).withColumn("rank", F.col("inside") + F.col("shift")).drop("part", "inside", "shift")


def pack(
    docs: DataFrame, tokenizer_file: str, ranks_file: str, key: str = "doc_id", text: str = "text", length: int = LENGTH
) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset): every piece and its place in a sequence.

    A document is its ids and then id 0; longer ones are cut every ``length`` ids, the rest is never cut. A sequence holds
    at most ``length`` ids without gaps. The driver sees only the histogram, of ``length`` rows at most, and the patterns
    made from it. Null and empty texts are the end id alone. Repeated rows, also of one key, are packed each. Null keys
    are kept. An empty table gives none.
    """
    pieces = settle(token_pieces(docs, key, text, length, tokenizer_file, ranks_file), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = slots(pack_histogram(counts, length))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for own in np.unique(n):
                here, rows = np.flatnonzero(n == own), table[int(own)]
                slot = rows[np.searchsorted(rows[:, 0], rank[here], side="right") - 1]
                sequence[here], offset[here] = slot[:, 1] + rank[here] - slot[:, 0], slot[:, 2]
            columns = [batch.column(c) for c in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    names = pieces.columns
    numbered = ranked(pieces, [key, "start", "ids_crc32"], counts).select(*names, "rank")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.mapInArrow(place, f"{fields}, sequence_id long, offset long")


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(load(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS))
