"""Periodic runs of words: Lyndon arrays under both orders by Baier grouping, Lyndon roots extended to runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.hashing import slices
from quire.llm.line_runs import BLANK
from quire.llm.registry import load, query

SHORTEST = 24  # words of a run
REPEATS = 3  # periods of a run
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def lyndon_groups(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of the longest Lyndon word that starts at each place, and a number that places of equal words share.

    Phase one of Baier's suffix sorter: groups of places, one for each letter at first, are taken from the highest down.
    The members of the highest group cannot grow any more. Chains of neighbouring members are joined to the lower word
    in front of them, and the words that took in a chain leave their group for a new one just above it, by the length
    of the chain. Every place is taken once and joined once.
    """
    n = len(codes)
    letters, own = np.unique(codes, return_inverse=True)
    group, size = own.tolist(), [0] * n
    cuts = np.cumsum(np.bincount(own, minlength=len(letters)))[:-1]
    members = [m.tolist() for m in np.split(np.argsort(own, kind="stable"), cuts)]
    above, below = list(range(1, len(letters) + 1)), list(range(-1, len(letters) - 1))
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    top = len(letters) - 1
    while top >= 0:
        grown: dict[tuple[int, int], list[int]] = {}
        for i in members[top]:
            front = left[i]
            if group[i] != top or (front >= 0 and group[front] == top):
                continue  # has left the group, or is not the first of its chain
            k, j = 0, i
            while j < n and group[j] == top:
                size[j] = right[j] - j
                k, j = k + 1, right[j]
            if j < n:
                left[j] = front
            if front >= 0:
                right[front] = j
                grown.setdefault((group[front], k), []).append(front)
        members[top], last, at = [], -1, -1
        for h, k in sorted(grown):
            at = at if h == last else h  # the chain of new groups above h rises with k
            new, over, last = len(members), above[at], h
            members.append(grown[h, k])
            above.append(over)
            below.append(at)
            above[at] = below[over] = new
            for p in grown[h, k]:
                group[p] = new
            at = new
        top = below[top]
    return np.array(size, dtype=np.int64), np.array(group, dtype=np.int64)


def common(codes: np.ndarray, a: int, b: int, step: int) -> int:
    """How far the words from places a < b on (step 1) or up to them (step -1) agree; compared in doubling blocks."""
    found, block = 0, 16
    while True:
        x, y = a + step * found, b + step * found
        if step > 0:
            some = min(block, len(codes) - y)
            same = codes[x : x + some] == codes[y : y + some]
        else:
            some = min(block, x + 1)
            same = codes[x - some + 1 : x + 1][::-1] == codes[y - some + 1 : y + 1][::-1]
        if some <= 0:
            return found
        if not same.all():
            return found + int(same.argmin())
        found, block = found + some, 2 * block


def runs_of(codes: np.ndarray, first: int, behind: int, shortest: int = SHORTEST, repeats: int = REPEATS) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text whose first two roots lie within ``first`` and ``behind``.

    In one of the two orders the root of a run is the longest Lyndon word at each place where it stands, so a run of
    three periods has two equal words in a row there. They are of one group; common extensions of both give the run.
    """
    part, found = codes[first:behind], set()
    for order in (part, -part.astype(np.int64)):
        size, group = lyndon_groups(order)
        places = np.arange(len(part))
        after = np.minimum(places + size, len(part) - 1)
        twice = (places + size < len(part)) & (group[after] == group)
        reached: dict[int, int] = {}
        for i in np.flatnonzero(twice).tolist():
            period, i = int(size[i]), i + first
            if reached.get(period, -1) > i + period:
                continue  # inside a run of this period that is known
            start = i - common(codes, i - 1, i + period - 1, -1)
            end = i + period + common(codes, i, i + period, 1)
            reached[period] = end
            if end - start >= max(shortest, repeats * period):
                found.add((start, end - start, period))
    return found


def repetitive(codes: np.ndarray, offsets: np.ndarray, shortest: int = SHORTEST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(text, first, behind) of the parts of texts that may hold runs; a text is a range of ``codes``.

    Behind its first period each word of a run has stood within a period before, and these words in a row are at least
    ``repeats`` - 1 periods. So rows of words seen no further back than the row allows are kept, and cut again while
    that leaves less. Nothing that belongs to a run is lost; ordinary prose is.
    """
    texts = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    n = len(codes)
    order = np.lexsort((codes, texts))  # stable, so places rise within equal words
    same = (codes[order][1:] == codes[order][:-1]) & (texts[order][1:] == texts[order][:-1])
    gap = np.full(n, n + 1, dtype=np.int64)
    gap[order[1:][same]] = np.diff(order)[same]
    least = -(-shortest * (repeats - 1) // repeats)  # words of a run behind its first period, at least
    alive = gap <= n
    while True:
        edges = np.flatnonzero(np.diff(np.concatenate([[False], alive, [False]]).astype(np.int8)))
        begin, end = edges[::2], edges[1::2]
        size = end - begin
        allowed = np.where(size >= least, size // (repeats - 1), 0)
        kept = alive.copy()
        kept[alive] = gap[alive] <= np.repeat(allowed, size)
        if np.array_equal(kept, alive):
            break
        alive = kept
    parts: list[tuple[int, int, int]] = []
    for a, b, back in zip(begin.tolist(), end.tolist(), allowed.tolist()):
        text = int(texts[a])
        a, b = max(a - back - int(offsets[text]), 0), b - int(offsets[text])
        while parts and parts[-1][0] == text and parts[-1][2] >= a:
            a = min(a, parts.pop()[1])
        parts.append((text, a, b))
    return parts


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all texts, equal for equal words, and where each text begins; empty words are left out."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten().dictionary_encode()
    codes = np.asarray(words.indices).astype(np.int64)
    bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    empty = pc.index(words.dictionary, "").as_py()
    full = codes != empty
    return codes[full], np.append(0, np.cumsum(full))[bounds]


def word_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, repeats: int = REPEATS, prune: bool = True
) -> DataFrame:
    """(key, n_words, runs, collapsed): runs are (start, length, period) in words, by start and period.

    Words stand between ASCII white space. A run is a stretch of words with a smallest period, at least ``repeats``
    periods and ``shortest`` words long, that no neighbouring word extends. ``collapsed`` has the words, one space
    apart, without those that a run contains behind its first period. ``prune`` keeps parts that cannot hold a run out of
    the grouping; the rows are the same without. Null and empty texts have no words, no runs and an empty ``collapsed``.
    Repeated rows and null keys stay. An empty table gives none. Other columns are not looked at. Nothing is shuffled; a
    worker holds some 8 MB of text, or one longer text, and about 150 bytes for each word of its longest part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            texts = pc.fill_null(batch.column("text"), "")
            codes, offsets = _coded(texts)
            sizes = np.diff(offsets)
            if prune:
                parts = repetitive(codes, offsets, shortest, repeats) if len(codes) else []
            else:
                parts = [(i, 0, n) for i, n in enumerate(sizes.tolist()) if n]
            of_text: dict[int, set] = {}
            for i, a, b in parts:
                own = codes[offsets[i] : offsets[i + 1]]
                of_text.setdefault(i, set()).update(runs_of(own, a, b, shortest, repeats))
            runs, collapsed = [], []
            for i, x in enumerate(texts):
                found = sorted(of_text.get(i, ()), key=lambda r: (r[0], r[2]))
                words = x.as_py().encode("utf-8", "surrogatepass").split()
                if found:
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    for start, length, period in found:
                        change[start + period] += 1
                        change[start + length] -= 1
                    words = [words[j] for j in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                collapsed.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            arrays = [batch.column("key"), pa.array(sizes, pa.int64()), pa.array(runs, RUNS), pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "n_words", "runs", "collapsed"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(run, out).withColumnRenamed("key", key)


def strongest(runs: Column) -> Column:
    """The run of the greatest exact exponent, the first by start and period of equal ones; null of none."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(more(best, r), r).otherwise(best))


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by CRC-32 of its id goes on from some word with repetitions of what follows."""
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    bare = F.btrim("text", F.lit(BLANK))
    some = (mark % 10 == 0) & (bare != "")
    rows = docs.select(
        "doc_id", "text", F.floor(mark / 10).alias("g"), F.when(some, F.split(bare, r"[\x20\x09-\x0D]+")).alias("words")
    ).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n AS int)")))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) AS int)"))
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.expr("cast((n - a + p - 1) div p AS int)")))
    whole = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), F.col("n") - F.col("a")))
    return rows.select("doc_id", F.when(F.col("words").isNotNull(), F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


@query("op11_word_runs")
def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs(with_repeated_tails(load(spark, sf_dir, "documents")))
    best = found.withColumn("best", strongest(F.col("runs")))
    told = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start"), F.col("best.length"), F.col("best.period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(told, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
