import numpy as np
import xxhash

from quire.llm import near_copies
from quire.llm.bitplanes import close_pairs
from quire.llm.components import components


def fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {n: find(n) for n in nodes}


def test_bit_planes_find_exactly_the_close_pairs():
    rng = np.random.default_rng(1)
    for lanes, radius in ((1, 4), (1, 9), (4, 56), (1, 0)):
        base = rng.integers(0, 2**64, (30, lanes), dtype=np.uint64)
        prints = base[rng.integers(0, 30, 300)].copy()
        for row in prints:
            for bit in rng.choice(64 * lanes, rng.integers(0, radius + 6), replace=False):
                row[bit // 64] ^= np.uint64(1 << int(bit % 64))
        starts = np.array([0, 1, 70, 200, 300])
        ends = starts[np.searchsorted(starts, np.arange(300), side="right")]
        want = {(i, j) for i in range(300) for j in range(i + 1, ends[i]) if np.bitwise_count(prints[i] ^ prints[j]).sum() <= radius}
        got = {(int(x), int(y)) for i, j in close_pairs(prints, ends, radius) for x, y in zip(i, j)}
        assert got == want


def test_masks_cover_every_choice_of_changed_bits():
    rng = np.random.default_rng(2)
    for rows in (10, 10**7, 10**12):
        masks = [m[0] for m in near_copies.multi_index(4, rows)]
        for _ in range(300):
            changed = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not changed & m for m in masks)


def test_components_against_union_find(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(500 + i, 501 + i) for i in range(60)] + [(7, 1000 + i) for i in range(50)]
    df = spark.createDataFrame([*pairs, *pairs[:9], (5, None), (None, None), (3, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    want = classes([p for p in pairs if p[0] != p[1]], {n for p in pairs for n in p if p[0] != p[1]})
    assert got == want
    assert components(df.limit(0)).count() == 0


def check(rows, df):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in df.collect())
    prints = [(i, fingerprint(t)) for i, t in rows]
    nodes = {i for i, _ in prints if i is not None}
    pairs = [(a, b) for k, (a, x) in enumerate(prints) for b, y in prints[:k] if None not in (a, b) and (x ^ y).bit_count() <= 4]
    roots = classes(pairs, nodes)
    null_of = {f: min((roots[i] for i, x in prints if i is not None and x == f), default=None) for i, f in prints if i is None}
    want = sorted((i is None, i or 0, f"{f:016x}", null_of[f] if i is None else roots[i]) for i, f in prints)
    assert got == want


def test_near_copies_against_brute_force(documents, odd, prose, monkeypatch):
    base = [prose(150) for _ in range(12)]
    rows = [(i, base[i % 12] if i % 3 else base[i % 12].replace(base[i % 12].split()[i % 150], "other", 1)) for i in range(80)]
    rows += [(200 + i, prose(3)) for i in range(5)] + odd
    check(rows, near_copies.near_copies(documents(rows, extra=("p0", "node", "component"))))
    monkeypatch.setattr(near_copies, "CELL", 4)  # buckets dealt out to pairs of parts
    check(rows, near_copies.near_copies(documents(rows)))
    assert near_copies.near_copies(documents([])).count() == 0
