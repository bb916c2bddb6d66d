import numpy as np

from quire.llm import neighbours as nn


def brute(rows, k=5):
    unit = {i: np.array(v, dtype=float) for i, v in rows}
    out = {}
    for q in unit:
        if q % 5 == 0:
            near = [(-round(float(unit[q] @ v / np.linalg.norm(unit[q]) / np.linalg.norm(v)), 12), i) for i, v in unit.items() if i != q]
            out[q] = [i for _, i in sorted(near)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def test_recall_and_exactness(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=24).astype("float32").tolist()) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # copies: ties go to the smaller id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want, query = brute(rows), lambda i: i % 5 == 0
    assert found(nn.neighbours(df, query, probes=1.0)) == want
    got = found(nn.neighbours(df, query))
    assert sum(len(set(a) & set(want[q])) for q, a in got.items()) / (5 * len(want)) >= 0.9
    monkeypatch.setattr(nn, "PLACE", 7)
    monkeypatch.setattr(nn, "ASKED", 3)
    assert found(nn.neighbours(df, query, probes=1.0)) == want


def test_odd_rows(spark):
    fields = "vec_id long, embedding array<float>, list long, id long"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (5, [1.0, 0.1]), (6, [0.0, 1.0]), (6, [0.0, 1.0]), (10, None), (15, [0.0, 0.0]), (20, [nan, 1.0]), (25, [inf, 1.0]),
            (30, [None, 1.0]), (35, [1.0]), (40, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], fields)
    got = found(nn.neighbours(df, lambda i: i % 5 == 0, probes=1.0))
    assert got == {0: [5, 6], 5: [0, 6]}
    assert nn.neighbours(df.limit(0), lambda i: i % 5 == 0).count() == 0
    one = df.where("vec_id = 0")
    assert nn.neighbours(one, lambda i: i % 5 == 0).count() == 0
