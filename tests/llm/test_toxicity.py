import random
import time
import zlib

import numpy as np
import pytest

from quire.llm import toxicity as tox
from quire.llm.segments import maximal_segments

BAD = ("vileword", "nastyterm", "badnoun")


def brute_segments(scores):
    """All maximal scoring segments by their definition: the best one, then the same left and right of it."""
    if not scores:
        return []
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=None)
    if best is None or best[0] <= 1e-12:
        return []
    a, b = -best[2], -best[2] - best[1]
    left, right = brute_segments(scores[:a]), brute_segments(scores[b:])
    return left + [(a, b, best[0])] + [(x + b, y + b, s) for x, y, s in right]


def test_segments_are_the_maximal_ones():
    rng = random.Random(5)
    for _ in range(300):
        scores = [rng.choice([-3.0, -1.25, -0.5, 1.0, 2.5]) * rng.uniform(0.9, 1.1) for _ in range(rng.randint(0, 14))]
        got = maximal_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(scores)]
        assert np.allclose([s for *_, s in got], [sum(scores[a:b]) for a, b, _ in got])


def test_segments_take_time_in_proportion():
    def seconds(n):
        start = time.perf_counter()
        found = maximal_segments([1.0, -2.0] * n)
        assert len(found) == n
        return time.perf_counter() - start

    assert seconds(160_000) < 8 * max(seconds(40_000), 0.02)


def test_buckets_of_words_and_stems():
    words = ["Word", "\"quoted\"", "ÄÖÜ-straße", "a", "", "---", "中文中文中文", "x" * 1000, "İstanbul"]
    want = []
    for w in words:
        w = w.strip(tox.EDGE).lower()
        want.append([zlib.crc32(x.encode()) % tox.BUCKETS for x in ("w" + w, "4" + w[:4], "5" + w[:5])])
    assert tox.buckets(words).tolist() == want and tox.buckets([]).shape == (0, 3)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    common = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1000, 1700):
        words = rng.choices(common, k=rng.randint(20, 120))
        toxic = i % 5 == 0
        for _ in range(4 if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_documents_are_told_apart(spark, documents, corpus, odd):
    rows, labels = corpus
    taught = spark.createDataFrame([*labels, (None, 1), (95, None), (10_000, 1)], "doc_id long, toxic int")
    found = tox.toxicity(documents([*rows, *odd], extra=("toxic", "kind", "fold", "id")), taught).collect()
    assert len(found) == len(rows) + len(odd)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found if r["doc_id"] is not None)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    truth, texts = dict(labels), dict(rows)
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth and r["doc_id"] not in range(90, 97)]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    for r in held:
        for p in r["passages"]:
            assert any(b in texts[r["doc_id"]][p["start"] : p["end"]] for b in BAD)
    assert all(r["predicted"] == 0 for r in found if r["doc_id"] in (90, 91, 92))


def test_learned_without_held_out_labels(spark, documents, corpus):
    """Turning the labels of held-out rows round changes nothing."""
    rows, labels = corpus
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    docs = documents(rows)
    a, b = (tox.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, turned))
    assert np.array_equal(a.gain, b.gain) and (a.bias, a.slope, a.rate, a.tail) == (b.bias, b.slope, b.rate, b.tail)


def test_no_labels_and_no_rows(spark, documents, prose):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in tox.toxicity(documents([(1, prose(20))]), none).collect()] == [0]
    assert tox.toxicity(documents([]), none).count() == 0


def test_rejected_rows_go_and_others_stay_whole(spark, documents, corpus, odd):
    rows, labels = corpus
    docs = documents([*rows, *odd])
    model = tox.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    stay = {r["doc_id"] for r in tox.score(docs, model).where(f"score < {tox.THRESHOLD}").collect()}
    kept = tox.without_toxic(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == stay
