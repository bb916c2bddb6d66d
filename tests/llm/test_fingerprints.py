import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import fingerprints as fp

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def plain_print(text):
    """128 signed vote sums of weighed terms, term by term."""
    words = WORD.findall((text or "").lower())
    terms = [words[i : i + 3] for i in range(max(len(words) - 2, 1))] if words else []
    votes = [0] * 128
    for term in terms:
        weight, h = min(sum(map(len, term)), 64), 42
        for w in term:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        # Spark hashes the int 1 as four bytes, then the long as eight, each with the hash so far as seed
        second = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42))
        for lane, x in enumerate((h, second)):
            for b in range(64):
                votes[64 * lane + b] += weight if x >> b & 1 else -weight
    return sum(1 << b for b, v in enumerate(votes) if v > 0)


def as_hex(x):
    return f"{x & 2**64 - 1:016x}{x >> 64:016x}"


def plain_query(rows):
    key = lambda r: (r[0] is not None, r[0] or 0)
    docs = sorted({(i, t or "") for i, t in rows}, key=key, reverse=True)
    prints = {t: plain_print(t) for _, t in docs}
    out = []
    for n, (i, text) in enumerate(docs):
        follows, half = docs[(n + 1) % len(docs)][1], len(text) // 2
        edited = text[: len(text) - half] + follows[:half]
        p, e, x = prints[text], plain_print(edited), prints[follows]
        near = sum(0 < (p ^ q).bit_count() <= fp.RADIUS for q in set(prints.values()))
        row = (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_hex(p), as_hex(e),
               1 - (p ^ e).bit_count() / 128, 1 - (p ^ x).bit_count() / 128, near)
        out += [row] * sum((j, t or "") == (i, text) for j, t in rows)
    return out


def ordered(rows):
    return sorted(map(str, map(tuple, rows)))


def test_query_against_votes_one_by_one(spark, tmp_path, documents, odd, prose):
    rng = random.Random(8)
    rows = [(i, prose(rng.randint(1, 80))) for i in range(1, 60)]
    base = prose(150).split()
    for i in range(40):  # near copies
        copy = list(base)
        copy[rng.randrange(len(copy))] = "changed"
        rows.append((200 + i, " ".join(copy)))
    rows += [(300, "One"), (301, "one two"), (302, " ONE\ttwo\nthree "), (303, "ÄÖ straße İ"), (-5, "minus"), (0, "a text without a key")] + odd
    rows = [(i, t) for i, t in rows if i != 94] + [(94, "word " * 500)]
    rows += [rows[3]] * 3
    for name, some in (("some", rows), ("one", rows[:1]), ("none", [])):
        documents(some, extra=("k", "h", "copies", "p0", "head", "kind", "grp")).repartition(3).write.parquet(str(tmp_path / name / "documents.parquet"))
        got = fp.op13_fingerprints(spark, str(tmp_path / name)).collect()
        assert ordered(got) == ordered(plain_query(some))
    assert max(r[-1] for r in plain_query(rows)) > 5
    plan = fp.op13_fingerprints(spark, str(tmp_path / "some"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_likeness_of_half_and_of_other_texts(spark, documents, prose):
    found = fp.document_fingerprints(documents([(i, prose(200)) for i in range(60)]))
    p, e, x = ([F.col(f"{c}{i}") for i in range(fp.LANES)] for c in "pex")
    mean = found.select(F.avg(fp.likeness(p, e)).alias("e"), F.avg(fp.likeness(p, x)).alias("x")).first()
    assert 0.62 < mean["e"] < 0.72 and 0.45 < mean["x"] < 0.55  # angles of 60 and 90 degrees


@pytest.mark.parametrize("cell", [fp.CELL, 16])
def test_near_counts_find_all_pairs_once(spark, monkeypatch, cell):
    monkeypatch.setattr(fp, "CELL", cell)
    rng, prints = random.Random(1), set()
    for _ in range(12):
        centre = rng.getrandbits(128)
        prints.add(centre)
        for _ in range(25):
            x = centre
            for b in rng.sample(range(128), rng.randint(0, 7)):
                x ^= 1 << b
            prints.add(x)
    prints |= {0, 1, 3, (1 << 128) - 1, 1 << 127}
    rows = [(signed(x & 2**64 - 1), signed(x >> 64)) for x in prints]
    got = fp.near_counts(spark.createDataFrame(rows * 2, "p0 long, p1 long")).collect()
    want = {(signed(x & 2**64 - 1), signed(x >> 64)): sum(0 < (x ^ y).bit_count() <= fp.RADIUS for y in prints) for x in prints}
    assert {(r["p0"], r["p1"]): r["n_near"] for r in got} == {k: n for k, n in want.items() if n}


def test_heads_are_shuffled_once(spark):
    """To the document before them, by the key they are joined on."""
    rows = spark.createDataFrame([(i, i, f"text {i}") for i in range(9)], "k long, h long, text string")
    ring = spark.createDataFrame([(i, i, 6, (i + 1) % 9, (i + 1) % 9) for i in range(9)], "k long, h long, n_chars int, next_k long, next_h long")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edited = fp.edited_texts(rows, ring)
        plan = edited._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, edited.select("k", "edited").collect())) == [(i, "tex" + "tex") for i in range(9)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 4  # texts twice, which is one, what is asked, heads
