from collections import defaultdict

from quire.llm import line_runs

UPPER = str.maketrans(line_runs.UPPER, line_runs.LOWER)


def brute(rows):
    """Kept text, lines and dropped lines of each row."""
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(UPPER)
    owners = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                owners[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or min(owners[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_dedup_against_brute_force(documents, odd, prose):
    shared = [prose(6) for _ in range(8)]
    rows = [(i, "\n".join([prose(5), shared[i % 8].upper() if i % 2 else f"  {shared[i % 8]}\t", "short", prose(4), shared[0]])) for i in range(40)]
    rows += [(7, shared[3]), (60, "ÉÉ" + prose(3) + "\n\n"), (61, "éé" + prose(3)), (62, "".join(shared)), *odd]
    rows += [(300 + i, shared[1] + "\n" + "own line of %d" % i) for i in range(30)]
    for batches in (1, 3, 7):
        df = line_runs.dedup_lines(documents(rows, extra=("n_lines", "pos", "owner", "h1")), batches=batches)
        got = sorted(((r["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"]) for r in df.collect()), key=str)
        assert got == brute(rows)
    assert line_runs.dedup_lines(documents([])).count() == 0


def test_levels_are_merged(spark):
    runs = line_runs.LineRuns(spark, fan=2, buckets=3)
    seen = set()
    for n in range(6):
        lines = [(h, h, 10 * n + d) for h, d in ((n, 1), (n + 1, 2), (99, 3))]
        got = {(r["h1"], r["owner"]) for r in runs.add(spark.createDataFrame(lines, "h1 long, h2 long, doc long")).collect()}
        assert got == {(h, o) for h, o in ((n, 10 * n - 8), (99, 3)) if h in seen}
        seen |= {n, n + 1, 99}
    assert [len(level) for level in runs.levels] == [0, 1, 1]


def test_no_python_in_the_plan(documents):
    df = line_runs.dedup_lines(documents([(1, "a line that repeats"), (2, "A line that repeats")]))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
