import math
import re
from collections import Counter

from quire.llm import licenses


def brute(files):
    """(path, text) to (licence, via, score), all units weighed."""
    find = lambda t: re.findall(licenses.TERM, (t or "").lower())
    vocabulary = {t for text in licenses.TEMPLATES.values() for t in find(text)}
    df = Counter(t for _, text in files for t in set(find(text)))
    weight = lambda t: 1 + math.log((len(files) + 1) / ((df[t] if t in vocabulary else 0) + 1))

    def nearest(text):
        tf, best = Counter(find(text)), (0.0, "")
        norm = math.sqrt(sum((n * weight(t)) ** 2 for t, n in tf.items()))
        for name, template in licenses.TEMPLATES.items():
            other = Counter(find(template))
            size = math.sqrt(sum((n * weight(t)) ** 2 for t, n in other.items()))
            dot = sum(n * other[t] * weight(t) ** 2 for t, n in tf.items())
            best = min(best, (-round(dot / norm / size, 6) if norm else 0.0, name))
        return best

    own, dirs = {}, {}
    for path, text in files:
        lines = [x for x in map(nearest, (text or "").split("\n")) if -x[0] >= licenses.HEADER_LEAST]
        own[path, text] = min(lines, default=None)
        whole = nearest(text)
        if path is not None and -whole[0] >= licenses.FILE_LEAST:
            folder = path.rpartition("/")[0]
            dirs[folder] = min(dirs.get(folder, (1, "", "")), (whole[0], path, whole[1]))
    out = []
    for path, text in files:
        if path is not None and own[path, text]:
            out.append((path, own[path, text][1], "header", -own[path, text][0]))
            continue
        above = path or ""
        while above and (above := above.rpartition("/")[0]) not in dirs and above:
            pass
        got = dirs.get(above) if path and "/" in path else None
        out.append((path, got[2], "directory", -got[0]) if got else (path, None, None, None))
    return sorted(out, key=str)


def test_scan_against_brute_force(spark, prose):
    t = licenses.TEMPLATES
    files = [
        ("/a/LICENSE", t["MIT"]), ("/a/x.py", prose(30)), ("/a/b/y.py", prose(5) + "\n" + t["Apache-2.0"] + "\n" + prose(9)), ("/a/b/c/z.py", prose(40)),
        ("/a/b/COPYING", t["GPL-3.0"] + " See the file."), ("/a/b/NOTICE", t["GPL-3.0"]), ("/q/r/s.txt", None), ("/q/r/t.txt", ""), (None, t["MIT"]),
        ("/q/deep.txt", "license " * 3 + prose(60)), ("noslash", prose(4)), ("/a/b/c/z.py", prose(40)), ("/a/x.py", t["MIT"]), ("/long", prose(4000) + " license"),
        ("/cc", "licensed under cc by-nc 4.0"), *[(f"/p/{i}.txt", prose(12)) for i in range(30)],
    ]
    fields = "path string, text string, licence string, score string, unit string, term string"
    df = licenses.scan(spark.createDataFrame([(*f, "x", "x", "x", "x") for f in files], fields))
    got = sorted(((r["path"], r["licence"], r["via"], r["score"]) for r in df.collect()), key=str)
    assert got == brute(files)
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_no_python_in_the_plan(spark):
    df = licenses.scan(spark.createDataFrame([("/a", "Released under the MIT License.")], "path string, text string"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString().replace("existingRDD", "")
