"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.hashing import shingle_hashes, simhash, slices
from quire.llm.registry import load, query
from quire.llm.scratch import settle

SHINGLE = 5
LEAST = 0.8
RADIUS = 23  # a similarity of 0.8 makes 13 of 64 bits differ on average, with a deviation of 3.2
BLOCKS = 8  # of 8 bits; within the radius, one of them differs in RADIUS // BLOCKS bits at most
FILTER_WORDS = 1 << 14, 1 << 20  # 64-bit words of the filter over item shingles: 8 bits a shingle, 128 KB to 8 MB
COMMON = 8, 50_000  # items that share a common shingle; shingles known to be common, at most. They only order shingles
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def normal(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(None, PUNCTUATION)


def needed(window: int, item: int) -> int:
    """Shingles that a window and an item of so many must share to be similar enough."""
    return math.ceil(LEAST * (window + item) / 2 - 1e-9)


def rarest(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], most: int) -> np.ndarray:
    """The distinct shingles among the first ``most`` of ``hashes`` in an order that puts common ones last.

    Two texts that must share o of their a and b shingles share one of the first a - o + 1 and b - o + 1 in any common
    order; the n-th occurrence of a shingle stands for one of its own.
    """
    known, counts = common
    at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
    rank = np.where(known[at] == hashes, counts[at], 0) if len(known) else np.zeros(len(hashes), dtype=np.int64)
    return np.unique(hashes[np.lexsort((hashes, rank))[:most]])


def _common(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many items have, sorted, and how many; a bounded list."""
    counted = items.select(F.explode(F.array_distinct("hashes")).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    rows = counted.where(F.col("n") >= COMMON[0]).orderBy(F.desc("n"), "h").limit(COMMON[1]).toPandas()
    hashes, n = (rows[c].to_numpy(dtype=np.int64) for c in ("h", "n"))
    order = np.argsort(hashes.view(np.uint64))
    return hashes.view(np.uint64)[order], n[order]


def _item_prefixes(items: DataFrame, shared) -> DataFrame:
    """(item, words, print, prefix) with the shingles one of which every similar window has among its rarest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column("hashes"):
                own = x.values.to_numpy().view(np.uint64)
                least = math.ceil(len(own) * LEAST / (2 - LEAST) - 1e-9)  # a window of as few shingles as can be similar
                found.append(rarest(own, shared.value[2], len(own) - least + 1).view(np.int64))
            names = ["item", "words", "print"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(found, pa.list_(pa.int64()))], [*names, "prefix"])

    kind = items.schema["item"].dataType.simpleString()
    return items.mapInArrow(run, f"item {kind}, words int, print long, prefix array<long>")


def _items(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, words, print, hashes) of items that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            keys, words, prints, hashes = [], [], [], []
            for i, x in enumerate(batch.column("text")):
                plain = normal(x.as_py())
                own = shingle_hashes(plain, SHINGLE)
                if len(own):
                    keys.append(i)
                    words.append(len(plain.split()))
                    prints.append(simhash(own).view(np.int64)[0])
                    hashes.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(pa.array(keys, pa.int64())), pa.array(words, pa.int32()),
                 pa.array(prints, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))],
                ["item", "words", "print", "hashes"],
            )

    kind = items.schema[key].dataType.simpleString()
    rows = items.where(F.col(key).isNotNull()).select(F.col(key).alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"item {kind}, words int, print long, hashes array<long>")


def _filter(items: DataFrame) -> np.ndarray:
    """Bits of all item shingles, merged in Spark: each as it is and together with its item's length, which tells
    shingles of items as long as a window from those of others. Its size follows the number of shingles."""
    shingles = 2 * (items.agg(F.sum(F.size("hashes"))).first()[0] or 0)
    size = min(max(1 << max(shingles // 8 - 1, 0).bit_length(), FILTER_WORDS[0]), FILTER_WORDS[1])
    h = F.col("h")
    place = F.shiftright(h, 24).bitwiseAND(F.lit(63)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    keyed = items.select(F.explode("hashes").alias("h"), (F.col("words").cast("long") * 2 + 1).alias("length"))
    keyed = keyed.select(F.explode(F.array("h", F.col("h").bitwiseXOR(F.col("length")))).alias("h"))
    bits = keyed.select(h.bitwiseAND(F.lit(size - 1)).alias("at"), bit.alias("bit"))
    rows = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(size, dtype=np.uint64)
    table[rows["at"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return table


def _windows(docs: DataFrame, shared) -> DataFrame:
    """(doc, version, start, words, print, hashes, prefix) of windows as long as some item that could be similar enough to one.

    Similarity needs a share of the window's shingles to be shingles of one item of that length. Windows in which fewer
    pass the filter are left out, which loses none: first by shingles of any item, then by those of items of the length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, lengths, common = shared.value

        def passes(hashes: np.ndarray) -> np.ndarray:
            word = bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)]
            return (word >> ((hashes >> np.uint64(24)) & np.uint64(63)) & np.uint64(1)).astype(np.int64)

        for batch in slices(batches, "text"):
            rows, starts, words, prints, hashes, prefixes = [], [], [], [], [], []
            for i, x in enumerate(batch.column("text")):
                plain = normal(x.as_py())
                n = len(plain.split())
                by_size: dict[int, tuple] = {}
                for m in lengths if n else []:
                    size = min(SHINGLE, m)
                    if size not in by_size:
                        own = shingle_hashes(plain, size)
                        by_size[size] = own, np.concatenate([[0], np.cumsum(passes(own))])
                    own, sums = by_size[size]
                    if not sums[-1]:
                        continue
                    wide = min(max(m - size + 1, 1), len(own))  # a shorter text is one window
                    need = needed(wide, max(m - size + 1, 1))
                    if (sums[wide:] - sums[:-wide]).max() < need:
                        continue
                    fine = np.concatenate([[0], np.cumsum(passes(own ^ np.uint64(2 * m + 1)))])
                    for a in np.flatnonzero(fine[wide:] - fine[:-wide] >= need).tolist():
                        part = own[a : a + wide]
                        rows.append(i)
                        starts.append(a)
                        words.append(m)
                        prints.append(simhash(part).view(np.int64)[0])
                        hashes.append(part.view(np.int64))
                        prefixes.append(rarest(part, common, wide - need + 1).view(np.int64))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(take), batch.column("version").take(take), pa.array(starts, pa.int32()),
                 pa.array(words, pa.int32()), pa.array(prints, pa.int64()),
                 *[pa.array(x, pa.list_(pa.int64())) for x in (hashes, prefixes)]],
                ["doc", "version", "start", "words", "print", "hashes", "prefix"],
            )

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc {kind}, version long, start int, words int, print long, hashes array<long>, prefix array<long>")


def _near(left: str, right: str) -> str:
    """Fingerprints within the radius, tried block by block first: one of them differs in few bits, or none is near."""
    blocks = [f"bit_count(shiftright({left} ^ {right}, {8 * b}) & 255L) <= {RADIUS // BLOCKS}" for b in range(BLOCKS)]
    return f"({' OR '.join(blocks)}) AND bit_count({left} ^ {right}) <= {RADIUS}"


def _candidates(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Windows next to each item of their length with which they share one of their rarest shingles; a pair may repeat.

    Fingerprint blocks alone let 71 % of unrelated pairs meet at this radius; a shared rare shingle is what similarity
    forces as well, so nothing is lost by it.
    """
    keys = windows.select("doc", "version", "start", "words", "print", F.explode("prefix").alias("shingle"))
    probes = items.select("item", "words", F.col("print").alias("item_print"), F.explode("prefix").alias("shingle"))
    return keys.join(probes, ["words", "shingle"])


def _similar(rows: DataFrame) -> DataFrame:
    """Add similarity: twice the weight that window and item share over the sum of their weights, a shingle weighing as
    often as it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b in zip(batch.column("hashes"), batch.column("item_hashes")):
                both, where = np.unique(np.concatenate([x.values.to_numpy() for x in (a, b)]), return_inverse=True)
                n, m = (np.bincount(x, minlength=len(both)) for x in (where[: len(a)], where[len(a) :]))
                found.append(2 * float(np.minimum(n, m).sum()) / (len(a) + len(b)))
            names = ["doc", "item", "start", "words"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(found, pa.float64())], [*names, "similarity"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc", "item", "start", "words"))
    return rows.mapInArrow(run, f"{kinds}, similarity double")


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(key, item_key, similarity, start_word, words): documents with a window similar to an item, one row for the two.

    Words are lower-cased and without ASCII punctuation. Similarity is of weighted five-word shingles, 0.8 at least; a
    window has the item's words, or is the whole text if that is shorter. Of equally similar windows the first counts.
    Items of fewer than five words are one shingle; those without words, null keys and null or empty texts match
    nothing. Repeated rows count once. Empty tables give none. Very long texts are read whole, a window at a time. Columns
    with other names are not looked at. The driver sees the lengths of items, a filter of ``FILTER_WORDS`` at most and the
    commonest shingles; fingerprints and shingles of items stay in Spark. Beyond 8 million item shingles the filter fills
    up and lets more windows through, with the same rows in the end.
    """
    spark = docs.sparkSession
    own = settle(_items(items, item_key, item_text), "items")
    lengths = sorted(r["words"] for r in own.select("words").distinct().collect())
    shared = spark.sparkContext.broadcast((_filter(own), lengths, _common(own)))
    rows = docs.where(F.col(key).isNotNull()).select(
        F.col(key).alias("doc"), F.xxhash64(text).alias("version"), F.col(text).alias("text")
    )
    windows = settle(_windows(rows, shared), "windows")
    near = _candidates(windows, _item_prefixes(own, shared)).where(_near("print", "item_print"))
    near = near.select("doc", "version", "start", "words", "item").distinct()
    pairs = near.join(windows.drop("print", "prefix"), ["doc", "version", "start", "words"])
    pairs = pairs.join(own.select("item", F.col("hashes").alias("item_hashes"), F.col("words").alias("item_words")), "item")
    pairs = pairs.where(F.col("words") == F.col("item_words"))
    found = _similar(pairs.select("doc", "item", "start", "words", "hashes", "item_hashes")).where(F.col("similarity") >= LEAST)
    best = found.groupBy("doc", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("at"), "words")).alias("b"))
    return best.select(
        F.col("doc").alias(key), F.col("item").alias(item_key), F.col("b.similarity").alias("similarity"),
        (-F.col("b.at")).alias("start_word"), F.col("b.words").alias("words"),
    )


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
