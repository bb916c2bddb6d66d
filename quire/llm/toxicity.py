"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by their extremes in clean text."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.hashing import slices
from quire.llm.registry import load, query
from quire.llm.scratch import settle
from quire.llm.segments import maximal_segments

BUCKETS = 1 << 18  # hashed tokens; bounds the model and what reaches the driver
SAMPLE = 20_000  # labelled documents learned from, at most
STEMS = (4, 5)  # a token also counts as its first letters
DRIFT = 0.25  # what each token costs, so that clean text scores below zero
SURE = 2.0  # standard errors taken off a log-odds
SIGNIFICANT = 0.01  # passages expected by chance in a document
THRESHOLD = 0.3
EDGE = "\"'`.,;:!?()[]{}<>*#$%&|-_…«»„“”¿¡/\\"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COUNTS = ("everywhere", "toxic0", "clean0", "toxic1", "clean1")


#: Checksums of the marks in front of a word's forms, from which those of the forms go on.
MARKS = tuple(zlib.crc32(m) for m in (b"w", *(str(n).encode() for n in STEMS)))


def buckets(words: list[str]) -> np.ndarray:
    """The buckets of each word's forms: ``w`` and the word, and each stem's length and the stem, by checksum."""
    out, crc, (whole, *stems) = [], zlib.crc32, MARKS
    for word in words:
        word = word.strip(EDGE).lower()
        code = word.encode("utf-8", "surrogatepass")
        out.append(crc(code, whole))
        if len(code) == len(word):
            out += [crc(code[:n], mark) for n, mark in zip(STEMS, stems)]
        else:
            out += [crc(word[:n].encode("utf-8", "surrogatepass"), mark) for n, mark in zip(STEMS, stems)]
    return np.array(out, dtype=np.int64).reshape(-1, 1 + len(STEMS)) % BUCKETS


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Offsets of each text's words, their numbers, and the distinct words; an empty word counts as none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    return offsets, np.asarray(coded.indices), coded.dictionary.to_pylist()


@dataclass
class Model:
    """Positive scores by bucket, buckets of words known to be clean, and the calibration."""

    gain: np.ndarray
    clean: np.ndarray
    rate: float = 1.0  # clean passages a token
    tail: float = 1.0  # their exponential tail
    bias: float = -30.0
    slope: float = 0.0

    def scores(self, buckets: np.ndarray) -> np.ndarray:
        gain = self.gain[buckets].max(axis=1) if len(buckets) else np.zeros(0)
        return np.where(len(buckets) and self.clean[buckets[:, 0]], 0.0, gain) - DRIFT

    def surprise(self, score: float, tokens: int) -> float:
        """Minus the logarithm of how many such passages chance gives in a document of so many tokens."""
        return self.tail * score - math.log(max(tokens, 1) * self.rate)


def log_odds(toxic: np.ndarray, clean: np.ndarray, everywhere: np.ndarray, tokens: tuple[float, float]) -> Model:
    """Log-odds of each bucket with the whole corpus as Dirichlet prior, less ``SURE`` standard errors."""
    n, m = tokens
    strength = max(n, 1.0)
    prior = strength * (everywhere + 0.5) / (everywhere.sum() + 0.5 * BUCKETS)
    a, b = toxic + prior, clean + prior
    odds = np.log(a / (n + strength - a).clip(1e-9)) - np.log(b / (m + strength - b).clip(1e-9))
    error = SURE * np.sqrt(1 / a + 1 / b)
    return Model(np.maximum(odds - error, 0).astype(np.float32), odds + error < 0)


def _count(docs: DataFrame) -> DataFrame:
    """Documents with a token of each bucket: of all, and by class and fold of the learned ones; bucket -1 has the sums.

    Counting documents, not places, keeps a word that one document repeats from counting as often found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(COUNTS), BUCKETS), dtype=np.int64)
        tokens = np.zeros(len(COUNTS), dtype=np.int64)
        for batch in slices(batches, "text"):
            offsets, where, names = _split(batch.column("text"))
            kind = np.asarray(pc.fill_null(batch.column("kind"), 0))
            doc = np.repeat(np.arange(len(kind)), np.diff(offsets))
            forms, full = buckets(names), np.array([bool(n) for n in names], dtype=bool)
            doc, where = doc[full[where]], where[full[where]]
            for form in forms.T:  # a token counts once in a document
                own, bucket = np.divmod(np.unique(doc * BUCKETS + form[where]), BUCKETS)
                for k in range(len(COUNTS)):
                    some = bucket if k == 0 else bucket[kind[own] == k]
                    sums[k] += np.bincount(some, minlength=BUCKETS)
                    tokens[k] += len(some)
        some = np.flatnonzero(sums.any(axis=0))
        rows = np.concatenate([sums[:, some], tokens[:, None]], axis=1)
        arrays = [pa.array(np.append(some, -1)), *[pa.array(x) for x in rows]]
        yield pa.RecordBatch.from_arrays(arrays, ["bucket", *COUNTS])

    rows = docs.select("text", "kind").mapInArrow(run, "bucket long, " + ", ".join(f"{c} long" for c in COUNTS))
    return rows.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _passages(texts: pa.Array, folds: np.ndarray, models: list[Model]) -> tuple[list[int], list[list]]:
    """Words of each text, and its passages (first character, behind the last, score) under the model of its fold."""
    offsets, where, names = _split(texts)
    forms = buckets(names)
    by_model = [m.scores(forms) for m in models]
    tables = [dict(zip(names, x.tolist())) for x in by_model]
    positive = [np.append(0, np.cumsum(x[where] > 0)) for x in by_model]
    sizes, found = np.diff(offsets).tolist(), []
    for i, f in enumerate(folds.tolist()):
        if positive[f][offsets[i + 1]] == positive[f][offsets[i]]:
            found.append([])
            continue
        text = texts[i].as_py()
        spans = [m.span() for m in WORD.finditer(text)]
        own = maximal_segments([tables[f][text[x:y]] for x, y in spans])
        found.append([(spans[x][0], spans[y - 1][1], s) for x, y, s in own])
    return sizes, found


def _learned_passages(rows: DataFrame, shared) -> DataFrame:
    """(kind, tokens, passages): scores of the passages of learned documents, by the other fold's model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            folds = np.asarray(batch.column("fold"), dtype=np.int64)
            sizes, found = _passages(batch.column("text"), folds, shared.value)
            scores = pa.array([[s for *_, s in x] for x in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(sizes, pa.int64()), scores], ["kind", "tokens", "passages"])

    return rows.select("text", "kind", "fold").mapInArrow(run, "kind int, tokens long, passages array<double>")


def _scored(batch: pa.RecordBatch, text: str, model: Model) -> tuple[list[float], list[list[dict]]]:
    sizes, found = _passages(batch.column(text), np.zeros(batch.num_rows, np.int64), [model])
    scores, toxic = [], []
    for n, own in zip(sizes, found):
        each = [model.surprise(s, n) for *_, s in own]
        scores.append(_logistic(model.bias + model.slope * math.log1p(sum(x for x in each if x > 0))))
        sure = [p for p, x in zip(own, each) if x >= -math.log(SIGNIFICANT)]
        toxic.append([{"start": a, "end": b, "score": s} for a, b, s in sure])
    return scores, toxic


PASSAGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope by Newton steps, with a little weight on small values."""
    w, ridge = np.array([math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0]), 1e-2
    features = np.stack([np.ones(len(x)), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        grad = features.T @ (p - y) + ridge * w
        hess = (features * (p * (1 - p))[:, None]).T @ features + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def held_out(key: str) -> F.Column:
    return F.crc32(F.col(key).cast("string")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled rows that are not held out, with token counts of all documents as prior.

    Rows are chosen by hash of the key. Two folds score each other's documents for the calibration, so that it sees
    scores as new documents get them. Only the counts by bucket and one number a learned document reach the driver.
    """
    learned = labels.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("toxic"))
    learned = learned.where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("id"))
    learned = learned.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample)
    fold = F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(2)).cast("int")
    learned = settle(learned.select("id", fold.alias("fold"), (1 + 2 * fold + (1 - F.col("toxic"))).cast("int").alias("kind")), "labels")
    learned = F.broadcast(learned)  # at most ``sample`` rows of 16 bytes
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    counted = _count(rows.join(learned, "id", "left")).toPandas().sort_values("bucket")
    tokens = counted.iloc[0, 1:].to_numpy(dtype=float) if len(counted) else np.zeros(len(COUNTS))
    sums = np.zeros((len(COUNTS), BUCKETS))
    some = counted.iloc[1:]
    sums[:, some["bucket"].to_numpy(dtype=np.int64)] = some[list(COUNTS)].to_numpy(dtype=float).T
    folds = [log_odds(sums[3 - 2 * f], sums[4 - 2 * f], sums[0], (tokens[3 - 2 * f], tokens[4 - 2 * f])) for f in (0, 1)]
    model = log_odds(sums[1] + sums[3], sums[2] + sums[4], sums[0], (tokens[1] + tokens[3], tokens[2] + tokens[4]))

    shared = docs.sparkSession.sparkContext.broadcast(folds)
    seen = settle(_learned_passages(rows.join(learned, "id"), shared), "passages")
    toxic = F.col("kind") % 2 == 1
    stats = seen.where(~toxic).agg(
        F.sum("tokens").alias("tokens"), F.sum(F.size("passages")).alias("k"),
        F.sum(F.aggregate("passages", F.lit(0.0), lambda a, x: a + x)).alias("s"),
    ).first()
    typical = seen.where(toxic).select(F.explode("passages").alias("s")).agg(F.avg("s")).first()[0] or 1.0
    model.rate = ((stats["k"] or 0) + 1) / ((stats["tokens"] or 0) + 1)
    model.tail = ((stats["k"] or 0) + 1) / ((stats["s"] or 0.0) + typical)
    surprise = F.aggregate(
        "passages", F.lit(0.0),
        lambda a, x: a + F.greatest(F.lit(0.0), x * model.tail - F.log(F.greatest("tokens", F.lit(1)) * model.rate)),
    )
    points = seen.select(toxic.cast("int").alias("y"), F.log1p(surprise).alias("x")).toPandas()
    if points["y"].nunique() == 2:
        model.bias, model.slope = fit_logistic(points["x"].to_numpy(), points["y"].to_numpy(dtype=float))
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, passages): the probability that a document is toxic and its significant passages by character."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            scores, toxic = _scored(batch, "text", shared.value)
            arrays = [batch.column("key"), pa.array(scores, pa.float64()), pa.array(toxic, PASSAGES)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "score", "passages"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = f"key {kind}, score double, passages array<struct<start:int,end:int,score:double>>"
    return rows.mapInArrow(run, out).withColumnRenamed("key", key)


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            scores, _ = _scored(batch, text, shared.value)
            yield batch.filter(pa.array([x < threshold for x in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted, passages) of every row.

    Keys are integers. Null and empty texts have no passages and so the lowest score. Repeated rows and null keys stay;
    a null key is not held out and not learned from. Without labels of both classes every score is about 0. An empty
    table gives none. No column but the text is an input of a score.
    """
    scored = score(docs, fit(docs, labels, key, text), key, text)
    return scored.select(
        key, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages",
    )


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")
