import hashlib
import zlib

from pyspark.sql import functions as F

from quire.llm import manifest as mf


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves, fanout=8):
    """The root of a list of digests, and the sibling groups (before, after) of each one, from the leaf up."""
    paths, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            first = a - a % fanout
            paths[i].append(("".join(nodes[first:a]), "".join(nodes[a + 1 : first + fanout])))
            at[i] = a // fanout
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of (doc_id, source, lang, n_chars, text) rows."""
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r, plain_leaf(r)))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for lang in order:
        langs[lang].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        subs[lang] = plain_tree([d for _, d in langs[lang]])
    root, tops = plain_tree([subs[x][0] for x in order])
    out = []
    for lang, top in zip(order, tops):
        for (r, own), path in zip(langs[lang], subs[lang][1]):
            path, node, text = path + top, own, r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
                node = plain_leaf((*r[:4], text))
            for before, after in path:
                node = sha(before + node + after)
            proof = sha("".join(a + b for a, b in path))
            out.append((r[0], own, subs[lang][0], root, proof, node, node == root))
    return out


def given(odd):
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i} É") for i in range(1, 75)]
    rows += [(i, None, "fr", None, f"text {i}") for i in range(100, 108)]
    rows += [(200, "s", "de", 3, "one"), (201, "s", None, 3, "No language"), (None, "s", None, 3, "no key"), (202, "s", "", 0, "")]
    rows += [(300, "s", "é", 1, "x"), (300, "s", "é", 1, "x"), (300, "s", "é", 1, "Y"), (301, "s", "z", 1, None)]
    return rows + [(i, "s", "odd", 0, t) for i, t in odd]


FIELDS = "doc_id long, source string, lang string, n_chars long, text string, digest string, grp string, path string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], FIELDS)


def ordered(rows):
    return sorted(map(str, map(tuple, rows)))


def test_query_against_plain_tree(spark, tmp_path, odd):
    for name, rows in (("some", given(odd)), ("one", given(odd)[:1]), ("many", [(i, "s", f"l{i % 70}", 1, "T") for i in range(90)])):
        table(spark, rows).repartition(5).write.parquet(str(tmp_path / name / "documents.parquet"))
        got = mf.op12_manifest(spark, str(tmp_path / name)).collect()
        assert ordered(got) == ordered(plain_manifest(rows))
    table(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert mf.op12_manifest(spark, str(tmp_path / "none")).collect() == []


def test_sql_against_plain_tree(odd, tmp_path, spark):
    import duckdb

    rows = [r for r in given(odd)]
    table(spark, rows).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cols = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    got = con.execute(f"SELECT {cols} FROM ({mf.SQL_TEXT})").fetchall()
    assert ordered(got) == ordered(plain_manifest(rows))


def test_other_fields_and_fanout(spark):
    docs = table(spark, [(i, "s", "en", i, f"t{i}") for i in range(30)])
    found = mf.manifest(docs, fields=("text",), key="n_chars", group="source", carry=("digest",), fanout=3)
    ok = found.select("n_chars", "digest", (mf.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert len(ok) == 30 and all(r["ok"] and r["digest"] == "x" for r in ok)
    root, _ = plain_tree([sha(f"{len(f't{i}')}:t{i}") for i in range(30)], 3)
    assert {r["root"] for r in found.collect()} == {root}
    wrong = found.select(mf.folded(F.sha2(F.col("leaf"), 256), F.col("path")) == F.col("root")).collect()
    assert not any(r[0] for r in wrong)
