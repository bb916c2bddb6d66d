"""Document fingerprints: weighted term hashes vote on signed bits; permuted block tables find those within a radius.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.line_runs import BLANK
from quire.llm.manifest import _numbered
from quire.llm.registry import load, query
from quire.llm.scratch import settle

LANES = 2  # of 64 bits
BITS = 64 * LANES
TERM = 3  # words of a term
HEAVIEST = 64  # characters of a term that count
RADIUS = 5
BLOCKS = 7  # any RADIUS differing bits leave BLOCKS - RADIUS blocks equal
CELL = 4096  # rows of a table's key in one place; more are dealt out to pairs of parts
PAIR = (1 << 32) | 1
PRINTS = [f"p{i}" for i in range(LANES)]


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(*keys, p0, p1): the fingerprint of each text, for keys that tell texts apart.

    A term is three words in a row, A-Z and other capitals lower-cased, or the whole of a shorter text; it weighs as many
    characters as it has, ``HEAVIEST`` at most, each time it occurs. Its hash votes with that weight for each bit it has
    set and against the others; a bit is set if the votes for it prevail. Two counters of 32 bits share a long, so 32
    sums a lane hold all votes, right up to 2^32 characters. Texts without words have no votes and no bit set. Rows of
    equal keys must have equal texts; they are one. Votes are summed before the shuffle, a row a text.
    """
    words = F.split(F.lower(F.btrim(text, F.lit(BLANK))), r"[\x20\x09-\x0D]+")
    rows = texts.select(*keys, words.alias("__words")).selectExpr(*keys, "__words", f"greatest(size(__words) - {TERM - 1}, 1) AS __n")
    parts = ", ".join(f"slice(__words, {i + 1}, __n)" for i in range(TERM))
    terms = rows.selectExpr(*keys, f"inline(arrays_zip({parts})) AS (__a, __b, __c)")
    size = " + ".join(f"coalesce(length({c}), 0)" for c in ("__a", "__b", "__c"))
    weighed = terms.selectExpr(*keys, f"cast(least({size}, {HEAVIEST}) AS long) AS __w", "xxhash64(__a, __b, __c) AS __h0")
    for lane in range(1, LANES):
        weighed = weighed.withColumn(f"__h{lane}", F.xxhash64(F.lit(lane), "__h0"))
    votes = [
        F.expr(f"sum((shiftright(__h{lane}, {j}) & {PAIR}L) * __w) AS __v{lane}_{j}") for lane in range(LANES) for j in range(32)
    ]
    summed = weighed.groupBy(*keys).agg(F.sum("__w").alias("__all"), *votes)
    return summed.selectExpr(*keys, *[f"{_prevailing(lane)} AS {PRINTS[lane]}" for lane in range(LANES)])


def _prevailing(lane: int) -> str:
    """The bits of a lane whose votes are more than half of all."""
    low = [f"IF(2 * (__v{lane}_{j} & 4294967295L) > __all, {1 << j}L, 0L)" for j in range(32)]
    high = [f"IF(2 * shiftrightunsigned(__v{lane}_{j}, 32) > __all, shiftleft({1 << j}L, 32), 0L)" for j in range(32)]
    return " | ".join(low + high)


def likeness(left: list[Column], right: list[Column]) -> Column:
    """The share of equal bits."""
    apart = reduce(Column.__add__, [F.bit_count(a.bitwiseXOR(b)) for a, b in zip(left, right)])
    return F.lit(1.0) - apart / F.lit(float(BITS))


def hexadecimal(prints: list[Column]) -> Column:
    return F.concat(*[F.lower(F.lpad(F.hex(p), 16, "0")) for p in prints])


def _block_masks() -> list[tuple[int, ...]]:
    """The bits of each block, by lane."""
    edges = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    wide = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(BLOCKS)]
    return [tuple(m >> (64 * lane) & (2**64 - 1) for lane in range(LANES)) for m in wide]


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def _masked(column: str, masks: tuple[int, ...]) -> list[str]:
    return [f"({column}{lane} & {_signed(m)}L)" for lane, m in enumerate(masks) if m]


def near_counts(prints: DataFrame) -> DataFrame:
    """(p0, p1, n_near): how many other of the distinct fingerprints lie within ``RADIUS`` bits of each; those with any.

    Fingerprints that differ in at most that many bits agree in two of the blocks at least. For each choice of two blocks
    there is a table in which these stand in front: rows that agree in front are compared. A pair is counted in the first
    of the tables in which it meets, so none is counted twice and none is shuffled. Keys of more than ``CELL`` rows are
    dealt out to a place for each pair of parts, so that no task has a whole one.
    """
    masks = _block_masks()
    tables = list(combinations(range(BLOCKS), BLOCKS - RADIUS))
    rows = prints.select(*PRINTS).distinct()
    entries = rows.selectExpr(*PRINTS, "inline(array(" + ", ".join(
        f"struct({t} AS t, xxhash64({', '.join(x for b in some for x in _masked('p', masks[b]))}) AS front)" for t, some in enumerate(tables)
    ) + "))")
    entries = settle(entries, "tables")
    sizes = entries.groupBy("t", "front").agg(F.count("*").alias("n")).where("n > 1")
    entries = entries.join(sizes, ["t", "front"])
    parts = f"cast(ceil(n / {CELL}) AS long)"
    own = entries.selectExpr("t", "front", *PRINTS, f"{parts} AS parts", f"pmod(xxhash64('part', p0, p1), {parts}) AS own")
    places = "explode(transform(sequence(0L, parts - 1), x -> least(own, x) * parts + greatest(own, x))) AS place"
    placed = own.selectExpr("t", "front", *PRINTS, "parts", "own", places)
    left = placed.selectExpr("t", "front", "place", "parts", "own", *[f"p{i} AS l{i}" for i in range(LANES)])
    right = placed.selectExpr("t AS t2", "front AS front2", "place AS place2", "own AS own2", *[f"p{i} AS r{i}" for i in range(LANES)])
    other = " OR ".join(f"l{i} <> r{i}" for i in range(LANES))
    apart = " + ".join(f"bit_count(l{i} ^ r{i})" for i in range(LANES))
    equal = [" AND ".join(f"{a} = {b}" for a, b in zip(_masked("l", m), _masked("r", m))) for m in masks]
    first = " ".join(f"WHEN {equal[a]} AND {equal[b]} THEN t = {t}" for t, (a, b) in enumerate(tables))
    once = "own <> own2 OR place = own * parts + own"  # rows of one part meet in all places of it
    pairs = left.join(right, F.expr(
        f"t = t2 AND front = front2 AND place = place2 AND ({other}) AND ({once}) AND {apart} <= {RADIUS} AND CASE {first} ELSE false END"
    ))
    return pairs.groupBy(*[f"l{i}" for i in range(LANES)]).agg(F.count("*").alias("n_near")).withColumnsRenamed({f"l{i}": f"p{i}" for i in range(LANES)})


def in_ring(rows: DataFrame, key: str) -> DataFrame:
    """(k, h, key, copies, n_chars, next_k, next_h) of the texts of ``rows`` (k, h, key, text), each next to the one that
    follows by descending key; after the last comes the first. Null keys are last, equal keys go by hash."""
    ids = rows.groupBy("k", "h").agg(F.max(key).alias("key"), F.count("*").alias("copies"), F.max(F.length("text")).alias("n_chars"))
    ids = settle(ids.withColumn("grp", F.lit("")), "ids")
    numbered = settle(_numbered(ids, F.col("key").desc_nulls_last(), F.col("h").asc()).drop("grp"), "ring")
    after = numbered.selectExpr("(idx + size - 1) % size AS idx", "k AS next_k", "h AS next_h")
    return settle(numbered.join(after, "idx").drop("idx", "size"), "ring")


def edited_texts(rows: DataFrame, ring: DataFrame) -> DataFrame:
    """(k, h, text, edited) of ``rows`` (k, h, text): the last half of each text replaced by the first as much of the next.

    Heads of the next text go to the key of the document before, are made one there and stay for the join.
    """
    asked = ring.selectExpr("next_k AS k", "next_h AS h", "k AS to_k", "h AS to_h", "n_chars div 2 AS n")
    heads = rows.select("k", "h", "text").join(asked, ["k", "h"]).selectExpr("to_k AS k", "to_h AS h", "n", "left(text, int(n)) AS head")
    heads = heads.groupBy("k", "h").agg(F.first("n").alias("n"), F.first("head").alias("head"))  # copies of the next document are one
    return rows.select("k", "h", "text").join(heads, ["k", "h"]).selectExpr(
        "k", "h", "text", "concat(left(text, int(length(text) - n)), head) AS edited"
    )


def document_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, copies, n_chars, edited_sha256, n_near, and p0, p1 of the text, the edited text and the next document's text:
    p0.., e0.., x0..) of every document.

    The edited text has the last half of its characters, rounded down, replaced by the first as many of the next document
    by descending key, or all it has; after the last document comes the first. ``n_near`` counts the other distinct
    fingerprints within ``RADIUS`` bits. Rows of one key and one text are one document of so many ``copies``; texts of
    one key follow one another. A null key is a document of its own behind the others. Null texts are empty. An empty
    table gives none. Other columns are not looked at. Texts are shuffled to the document before them, half of each, and
    where ids are too many to broadcast once by key.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(key), F.lit(0)).cast("long").alias("k"), F.xxhash64(F.col(key).isNull(), own).alias("h"),
        F.col(key).cast("long").alias(key), own.alias("text"),
    )
    ring = in_ring(rows, key)
    edited = edited_texts(rows, ring)
    both = "inline(array(struct('p' AS kind, text), struct('e' AS kind, edited AS text)))"
    texts = edited.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).selectExpr("k", "h", "edited_sha256", both)
    prints = settle(fingerprints(texts, ["k", "h", "edited_sha256", "kind"]), "prints")

    def of(kind: str, name: str) -> DataFrame:
        return prints.where(F.col("kind") == kind).select("k", "h", *[F.col(p).alias(f"{name}{i}") for i, p in enumerate(PRINTS)])

    near = near_counts(prints.where("kind = 'p'"))
    found = ring.join(prints.where("kind = 'p'").drop("kind"), ["k", "h"]).join(of("e", "e"), ["k", "h"])
    found = found.join(of("p", "x").withColumnsRenamed({"k": "next_k", "h": "next_h"}), ["next_k", "next_h"])
    found = found.join(near, PRINTS, "left")
    names = [f"{c}{i}" for c in "pex" for i in range(LANES)]
    return found.select(F.col("key").alias(key), "copies", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
                        F.coalesce("n_near", F.lit(0)).alias("n_near"), *names)


@query("op13_fingerprints")
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = document_fingerprints(load(spark, sf_dir, "documents"))
    p, e, x = ([F.col(f"{c}{i}") for i in range(LANES)] for c in "pex")
    rows = found.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", hexadecimal(p).alias("fingerprint"), hexadecimal(e).alias("edited_fingerprint"),
        likeness(p, e).alias("near_edited"), likeness(p, x).alias("near_next"), "n_near",
    )
