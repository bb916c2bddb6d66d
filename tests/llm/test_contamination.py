import random
from collections import Counter

import numpy as np

from quire.llm import contamination as con


def brute(docs, items):
    """Every window of every document against every item of its length."""
    words = lambda t: con.normal(t).decode().split()

    def shingles(w):
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    out = set()
    for d, t in docs:
        own = words(t)
        for item, text in items:
            m = len(words(text))
            if d is None or item is None or not own or not m:
                continue
            want, best = shingles(words(text)), 0
            for a in range(max(1, len(own) - m + 1)):
                have = shingles(own[a : a + m])
                best = max(best, 2 * sum((want & have).values()) / (sum(want.values()) + sum(have.values())))
            if best >= 0.8 - 1e-12:
                out.add((d, item, round(best, 9)))
    return out


def test_against_brute_force(spark, documents, prose, odd):
    items = [(i, prose(12 + 5 * i)) for i in range(9)] + [(20, prose(3)), (21, None), (22, " . "), (None, prose(20)), (23, "same same " * 9)]
    text = dict(items)

    def changed(t, k):
        w = t.split()
        for i in range(k):
            w[len(w) - 1 - i] = "changed"
        return " ".join(w)

    docs = [(i, f"{prose(40)} {text[i % 9]} {prose(30)}") for i in range(18)]
    docs += [(30 + i, f"{prose(25)} {changed(text[i], i)} {prose(5)}") for i in range(9)]
    docs += [(50, text[4].upper().replace(" ", ",  \n")), (51, text[8][:-30]), (52, text[20]), (53, f"x {text[20]} y"), (54, "same " * 40), (55, prose(500)), (50, prose(9))]
    docs += [*odd, *[(60 + i, prose(80)) for i in range(20)]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = con.contaminated(documents(docs, extra=("item_id", "words", "print", "hashes")), bench)
    got = {(r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in df.collect()}
    assert got == brute(docs, items) and len({d for d, *_ in got}) > 20 and df.count() == len(got)
    for a, b in ((documents([]), bench), (documents(docs), bench.limit(0))):
        assert con.contaminated(a, b).count() == 0


def test_any_order_of_shingles_keeps_a_common_one():
    rng = np.random.default_rng(3)
    for _ in range(400):
        m = int(rng.integers(1, 60))
        item = rng.integers(0, rng.choice([5, 1000]), m).astype(np.uint64)
        window = item[: rng.integers(max(1, m * 2 // 3), m + 1)].copy()
        for at in rng.integers(0, len(window), rng.integers(0, m // 4 + 1)):
            window[at] = rng.integers(0, 1000)
        both = Counter(window.tolist()) & Counter(item.tolist())
        need = con.needed(len(window), m)
        if sum(both.values()) < need:
            continue
        known = np.unique(rng.integers(0, 1000, 50).astype(np.uint64))
        common = known, rng.integers(8, 99, len(known))
        least = -(-m * 2 // 3)
        assert set(con.rarest(window, common, len(window) - need + 1).tolist()) & set(con.rarest(item, common, m - least + 1).tolist())


def test_many_items_of_one_length_meet_few_windows(spark, documents, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    frame = "the same frame opens every item of this benchmark table".split()  # shingles that all items share
    texts = [" ".join(frame + rng.choices(words, k=30)) for _ in range(10_000)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    planted = {i: rng.randrange(10_000) for i in range(300)}
    docs = documents([(i, " ".join([*rng.choices(words, k=50), texts[n], *rng.choices(words, k=20)])) for i, n in planted.items()])
    seen, whole = {}, con._candidates

    def counted(windows, own):
        found = whole(windows, own)
        seen["met"], seen["windows"] = found.select("doc", "start", "item").distinct().count(), windows.count()
        return found

    monkeypatch.setattr(con, "_candidates", counted)
    got = {(r["doc_id"], r["item_id"]) for r in con.contaminated(docs, items).collect()}
    assert got == set(planted.items())
    assert seen["windows"] >= 300 and seen["met"] < 0.01 * seen["windows"] * 10_000
