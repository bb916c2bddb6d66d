import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import registry
from quire.sources import json_members, registry_json

RECORD = "struct<t:string,n:int>"
AWKWARD = ["", "plain", 'say "so"', "{", "}", "}}", '{"a": {"b": 1}}', "back\\slash", "ends with \\", "\\\"}", "[x]", "é ß", "new\nline\ttab", ", \"essays\": {"]


@pytest.fixture
def small_blocks(spark):
    """Files are read in blocks of a few bytes, so that strings, escapes and records lie across their borders."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "97")
    yield
    spark.conf.set(name, before)


def expected(text):
    """What a strict reader of whole files gives: members in order, or nothing."""
    try:
        state = json.loads(text)
        return [(k, v.get("t"), v.get("n")) for k, v in state.get("essays", {}).items()]
    except (ValueError, AttributeError):
        return []


def documents():
    rng = random.Random(11)
    texts = []
    for i in range(40):
        keys = rng.sample(AWKWARD, rng.randint(0, len(AWKWARD)))
        state = {"last_update": rng.choice([None, *AWKWARD]), "essays": {k: {"t": rng.choice(AWKWARD), "n": i, "more": [{"x": "}"}, {}]} for k in keys}}
        if i % 3 == 0:
            state = {"before": {"essays": {"t": "no"}, "x": {}}, "list": [1, "]}"], **state, "after": {"t": {"n": 1}}, "end": rng.choice(AWKWARD)}
        texts.append(json.dumps(state, indent=rng.choice([None, 0, 2]), ensure_ascii=rng.random() < 0.5) + rng.choice(["", "\n", " \n\n"]))
    whole = json.dumps({"last_update": "now", "essays": {"a": {"t": "x{"}, "b": {"t": "}"}}}, indent=2)
    texts += [whole[:n] for n in (0, 1, 20, len(whole) // 2, len(whole) - 12, len(whole) - 1)]
    texts += [whole + end for end in ("}", "x", "{}", whole, ",")]
    texts += [whole.replace("},", "}"), whole.replace("},", "},,"), whole.replace('"b": ', ""), whole.replace('"t": "x{"', '"t": "x{'), "{not json", "[]", "{}", "{} \n", "\n"]
    texts += ['{"essays": {}}', '{"essays": {"a": 1}}', '{"essays": {"a": {}, "b": null}}', '{"essays": {"a": {},}}', '{"essays": {"a": {}},}', '{"x": 1,, "essays": {"a": {}}}']
    texts += ['{"essays": {"a": {"t": "1"}, "b": {"t": "2"}, "a": {"t": "3"}}}', '{"essays": {"a": {"t": "1"}}, "essays": {"b": {"t": "2"}}}', '{"other": {"a": {}}}']
    return texts


def test_members_equal_a_reader_of_whole_files(spark, tmp_path, small_blocks):
    texts = documents()
    for i, text in enumerate(texts):
        (tmp_path / f"{i:03d}.json").write_text(text, encoding="utf-8")
    rows, roots = json_members.members(spark, str(tmp_path), "essays", RECORD)
    found = {}
    for r in rows.select(F.regexp_extract("file", r"(\d+)\.json", 1).cast("int").alias("f"), "pos", "key", "value").collect():
        found.setdefault(r.f, []).append((r.pos, r.key, r.value.t, r.value.n))
    for i, text in enumerate(texts):
        assert [x[1:] for x in sorted(found.get(i, []))] == expected(text), text
    said = {int(r.file[-8:-5]): (r["values"] or {}).get("last_update") for r in roots.collect()}
    for i, text in enumerate(texts[:40]):
        assert said[i] == json.loads(text)["last_update"], text


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    state = {"last_update": "now", "essays": {f"{i}.html": {"title": f"T {i} }}", "url": "u", "read": i % 2 == 0} for i in range(500)}}
    for name, indent in (("wide", 2), ("flat", None)):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(state, indent=indent))
        assert json_members._pieces(spark, str(path)).rdd.getNumPartitions() > 100
        rows = registry_json.read_state(spark, str(path)).orderBy("first_pos").collect()
        assert [(r.doc_id, r.title, r.read) for r in rows] == [(k, v["title"], v["read"]) for k, v in state["essays"].items()]


def test_state_files_have_the_indented_layout(spark, tmp_path):
    at = dt.datetime(2024, 5, 6, 7, 8, 9)
    rows = [(f"{i}.html", AWKWARD[i], "u", None if i % 2 else "2001-01-01", "", i % 3 == 0, at, i) for i in range(len(AWKWARD))]
    registry_json.write_state_files(spark.createDataFrame(rows, registry.SCHEMA), str(tmp_path / "s"), at, documents=4)
    files = sorted((tmp_path / "s").glob("file=*/part-*"))
    assert len(files) == -(-len(AWKWARD) // 4)
    entries = {}
    for f in files:
        text = f.read_text(encoding="utf-8")
        state = json.loads(text)
        assert state["last_update"] == at.isoformat() and text == json.dumps(state, indent=2, ensure_ascii=False) + "\n"
        entries |= state["essays"]
    assert [(k, e["essay_id"], e["title"], e["date"], e["read"]) for k, e in entries.items()] == [(r[0], r[0], r[1], r[3], r[5]) for r in rows]
    back = registry_json.read_state(spark, str(tmp_path / "s")).drop("first_pos")
    assert sorted(map(tuple, back.collect()), key=str) == sorted((r[:7] for r in rows), key=str)
    assert {r.last_update for r in registry_json.read_last_update(spark, str(tmp_path / "s")).collect()} == {at.isoformat()}
