import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quire.llm import word_runs as wr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, shortest=24, repeats=3):
    """All maximal repetitions by trying every period."""
    n, found = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, repeats * q):
                found.setdefault((i, j + q), q)  # smaller periods come first
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def is_lyndon(word):
    return all(word < word[i:] for i in range(1, len(word)))


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_groups_are_longest_lyndon_words(letters):
    rng = random.Random(letters)
    for n in [*range(1, 12), 40, 60]:
        for _ in range(20):
            text = [rng.randrange(letters) for _ in range(n)]
            size, group = wr.lyndon_groups(np.array(text))
            words = {}
            for i in range(n):
                want = max(k for k in range(1, n - i + 1) if is_lyndon(text[i : i + k]))
                assert size[i] == want
                words.setdefault(int(group[i]), set()).add(tuple(text[i : i + want]))
            assert all(len(w) == 1 for w in words.values())
            assert len(set().union(*words.values())) == len(words)


def strange_texts():
    rng = random.Random(9)
    fib = ["a", "b"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    thue = [bin(i).count("1") % 2 for i in range(256)]
    yield list(fib[-1])
    yield thue
    yield [1] * 100
    yield list(range(90)) * 3
    yield list(range(30)) * 2 + [7] + list(range(30)) * 4 + [99]
    yield [0, 1] * 12 + [2] + [0, 1] * 11 + [0]
    yield ([0] * 24 + [1]) * 3
    for letters in (2, 3, 50):
        for _ in range(40):
            text = []
            while len(text) < 200:
                part = [rng.randrange(letters) for _ in range(rng.randint(1, 20))]
                text += part * rng.choice([1, 1, 3, 4, 9]) + part[: rng.randint(0, len(part))]
            yield text


def test_runs_against_every_period():
    for text in strange_texts():
        codes = np.unique(np.array(text), return_inverse=True)[1].astype(np.int64)
        want = plain_runs(codes.tolist())
        key = lambda r: (r[0], r[2])
        assert sorted(wr.runs_of(codes, 0, len(codes)), key=key) == sorted(want, key=key)
        pruned = set()
        for _, a, b in wr.repetitive(codes, np.array([0, len(codes)])):
            pruned |= wr.runs_of(codes, a, b)
        assert pruned == set(want)
        for few in (4, 10):  # other limits
            assert wr.runs_of(codes, 0, len(codes), few, 4) == set(plain_runs(codes.tolist(), few, 4))


def test_a_long_repetitive_text_takes_time_in_proportion():
    import time

    def seconds(n):
        codes = np.random.default_rng(1).integers(0, 3, n)
        start = time.perf_counter()
        wr.runs_of(codes, 0, n)
        return time.perf_counter() - start

    assert seconds(200_000) < 6 * max(seconds(50_000), 0.05)


def plain_tail(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def rows_of(rng, odd, prose):
    marked = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    rows = [(i, prose(rng.randint(1, 120))) for i in marked]
    rows += [(5000 + i, " ".join(rng.choices("a b c".split(), k=60))) for i in range(20)]
    rows += [(6000, "x \t y\n" * 30), (6001, "  a b " * 12 + "\x1c"), (6002, " ".join(["lo mi"] * 12)), (6003, "one")]
    rows += [(6004, prose(30) + " " + "very long row " * 3000 + prose(5)), (marked[0], ""), (marked[1], None)]
    return rows + odd


def test_query_against_every_period(spark, tmp_path, documents, odd, prose):
    rng = random.Random(5)
    rows = rows_of(rng, [r for r in odd if r[0] != 94], prose) + [(94, "word " * 300)]
    path = str(tmp_path / "documents.parquet")
    documents(rows, extra=("key", "runs", "words", "n")).write.parquet(path)
    got = wr.op11_word_runs(spark, str(tmp_path)).collect()

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    want = []
    for doc_id, text in rows:
        words = plain_tail(doc_id, text)
        if len(words) > 5000:  # the period of this text is known
            runs = [(30, 9000, 3)]
        else:
            runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        milli = 1000 * best[1] // best[2] if runs else None
        want.append((doc_id, len(runs), *best, milli, sha(told), sha(plain_collapse(words, runs))))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_same_rows_without_pruning(spark, documents, odd, prose):
    docs = documents(rows_of(random.Random(6), odd, prose)).repartition(3)
    plain = {tuple(map(str, r)) for r in wr.word_runs(docs, prune=False).collect()}
    assert {tuple(map(str, r)) for r in wr.word_runs(docs).collect()} == plain
    assert wr.word_runs(documents([])).collect() == []
