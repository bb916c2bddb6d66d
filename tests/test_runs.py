"""Sources, whole builds and the stream."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quire.operators import incremental, registry
from quire.plans.build import build, listed, parse_pages
from quire.rules import DEFAULT
from quire.sources import content_store, registry_json
from quire.sources.content_store import ContentStore
from quire.sources.pages import read_pages, write_bucketed
from quire.sources.versioned import VersionedTable
from quire.streaming.ingest import PageIngest

AT = dt.datetime(2024, 3, 1, 12)
LONG = "A sentence with enough words in it to count as the content of a page, more or less. " * 3


def page(date, body=LONG):
    return f"<html><body><font size='2' face='verdana'>{date}<br><br>{body}</font></body></html>"


INDEX = """<ul><li><a href="a.html">Alpha</a></li><li><a href="b.html">Beta</a> May 1999</li><li><a href="gone.html">Gone</a></li>
<li><a href="thin.html">Thin one</a></li></ul>"""
RULES = DEFAULT.but(site_base="http://s.example")


@pytest.fixture()
def site(spark):
    rows = [(1, "http://s.example/a.html", page("January 2004")), (2, "http://s.example/b.html", page("nothing")),
            (3, "http://s.example/gone.html", ""), (4, "http://s.example/thin.html", page("2001", "Thin.")),
            (5, "http://s.example/a.html", page("January 2020"))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return pages, spark.createDataFrame([(9, INDEX)], "page_id bigint, html string")


def test_build_rebuild_and_force(spark, site, tmp_path):
    pages, index = site
    root, out = str(tmp_path / "run"), str(tmp_path / "out")
    book, counts = build(spark, root, pages, index, AT, rules=RULES, output=out)
    assert counts == {"cached": 0, "fetched": 3}
    order = [r.doc_id for r in book.spine.orderBy("ordinal").collect()]
    assert order == ["a.html", "b.html"]
    assert [r.title for r in book.toc.orderBy("ordinal").collect()] == ["Alpha (January 2004)", "Beta (May 1999)"]
    assert spark.read.parquet(f"{out}/chapters").count() == 2
    again, counts = build(spark, root, pages, index, AT, order="asc", rules=RULES)
    assert counts == {"cached": 3, "fetched": 0}
    assert [r.doc_id for r in again.spine.orderBy("ordinal").collect()] == ["b.html", "a.html"]
    none = pages.limit(0)
    rebuilt, counts = build(spark, root, none, None, AT, rebuild=True, rules=RULES)
    assert [r.doc_id for r in rebuilt.spine.orderBy("ordinal").collect()] == order
    forced, counts = build(spark, root, pages, index, AT, rebuild=True, force_refresh=True, rules=RULES)
    assert counts == {"cached": 0, "fetched": 3}
    with pytest.raises(ValueError):
        build(spark, str(tmp_path / "none"), none, None, AT, rebuild=True)


def test_first_copies_are_parsed(spark, site):
    pages, _ = site
    todo = spark.createDataFrame([("a.html", "http://s.example/a.html", "A"), ("g", "http://s.example/gone.html", "G")], "doc_id string, url string, title string")
    assert parse_pages(pages, todo).select("doc_id", "page_date").collect() == [("a.html", "2004-01-01")]


def test_several_index_pages_are_numbered_together(spark):
    lists = [(2, '<a href="http://z.example/1.html">Zeta zero</a><a href="b.html">Beta page</a>'), (1, '<a href="a.html">Alpha page</a><a href="c.html">Gamma page</a>')]
    rows = listed(spark.createDataFrame(lists, "page_id bigint, html string"), RULES.but(external_allow=("example",)))
    assert [r.title for r in rows.orderBy("pos").collect()] == ["Alpha page", "Gamma page", "Zeta zero", "Beta page"]
    assert [r.pos for r in rows.orderBy("pos").collect()] == [0, 1, 2, 3]
    tied = spark.createDataFrame([("d", "Alpha", "http://z/1", None, None, 0), ("d", "Zeta", "http://a/2", None, None, 0)], "doc_id string, title string, url string, date string, raw_date_str string, pos bigint")
    row = registry.last_per_document(tied).first()
    assert (row.title, row.url) in {("Alpha", "http://z/1"), ("Zeta", "http://a/2")}


def test_dates_survive_a_crash_before_the_registry(spark, site, tmp_path):
    """Content was stored, then the run died: the next run takes the date from the store."""
    pages, _ = site
    index = spark.createDataFrame([(9, '<a href="a.html">Alpha page</a>')], "page_id bigint, html string")
    root = str(tmp_path / "crash")
    todo = spark.createDataFrame([("a.html", "http://s.example/a.html", "Alpha page")], "doc_id string, url string, title string")
    ContentStore(spark, f"{root}/content").append(parse_pages(pages, todo, RULES))
    book, counts = build(spark, root, pages, index, AT, rules=RULES)
    assert counts == {"cached": 1, "fetched": 0}
    assert [r.title for r in book.toc.collect()] == ["Alpha page (January 2004)"]


def test_images_reach_content_and_collection(spark, site, tmp_path):
    pages, index = site
    shown = pages.withColumn("html", F.regexp_replace("html", "</font>", "<img src=pic.gif><img src=spacer.gif><img src=tiny.png></font>"))
    files = [("http://s.example/pic.gif", 90, 90, b"GIF"), ("http://s.example/tiny.png", 9, 90, b"x"), ("http://s.example/spacer.gif", 90, 90, b"s")]
    images = spark.createDataFrame(files, "url string, width int, height int, data binary")
    root, out = str(tmp_path / "run"), str(tmp_path / "out")
    book, _ = build(spark, root, shown, index, AT, rules=RULES, output=out, images=images)
    stored = {r.doc_id: [bytes(i.data) for i in r.images] for r in ContentStore(spark, f"{root}/content").read().collect()}
    assert stored["a.html"] == stored["b.html"] == [b"GIF"]
    written = spark.read.parquet(f"{out}/images").collect()
    assert [(r.ordinal, r.doc_id, r.file_name[-4:], bytes(r.data)) for r in written] == [(1, "a.html", ".gif", b"GIF")]


def land(spark, folder, rows):
    schema = "page_id bigint, url string, html string"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


FIELDS = ["doc_id", "title", "url", "date", "raw_date_str", "read"]


def test_stream_equals_batch(spark, tmp_path):
    url = "http://s.example/{}.html".format
    parts = [[(i, url(i), page(f"May {2000 + i}")) for i in part] for part in ([0, 1], [2, 3], [1, 4])]
    parts[1] += [(9, url(2), page("May 1990")), (None, url(7), page("May 2007")), (5, None, page("x")), (6, url("empty"), " ")]
    for rows in parts:
        land(spark, tmp_path / "landing", rows)
    stream = PageIngest(spark, str(tmp_path / "landing"), str(tmp_path / "s"), AT)
    stream.run(max_files_per_batch=2)
    assert len(stream.content.batches()) == 2
    once = PageIngest(spark, str(tmp_path / "landing"), str(tmp_path / "b"), AT)
    once.run()
    assert len(once.content.batches()) == 1
    content = [sorted((r.doc_id, r.content_html) for r in x.content.read().collect()) for x in (stream, once)]
    assert content[0] == content[1] and len(content[0]) == 6
    rows = [sorted(map(tuple, x.registry().select(FIELDS).collect())) for x in (stream, once)]
    assert rows[0] == rows[1] and dict((r[0], r[3]) for r in rows[0])[url(2)] == "2002-05-01"
    places = {r.doc_id: r.first_pos for r in stream.registry().collect()}
    assert max(places[url(i)] for i in range(3)) < places[url(4)] and places[url(3)] < places[url(7)]


def test_stream_state_lives_from_run_to_run(spark, tmp_path):
    """Later runs parse only what is new, and note the rest as seen, out of state and not out of written tables."""
    land(spark, tmp_path / "landing", [(i, f"u{i}", page("May 2001")) for i in range(4)])
    first = PageIngest(spark, str(tmp_path / "landing"), str(tmp_path / "s"), AT)
    first.run()
    later = PageIngest(spark, str(tmp_path / "landing"), str(tmp_path / "s"), AT + dt.timedelta(days=1))
    later.run()  # nothing new
    assert later.content.batches() == [1] and {r.last_seen for r in later.registry().collect()} == {AT}
    land(spark, tmp_path / "landing", [(7, "u1", page("June 2009", "Another text. " * 30)), (8, "u1", page("July 2009")), (9, "new", page("May 2002"))])
    later.run()
    rows = {r.doc_id: r for r in later.registry().collect()}
    assert len(rows) == 5 and rows["u1"].date == "2001-05-01" and rows["new"].date == "2002-05-01"
    assert {k for k, r in rows.items() if r.last_seen > AT} == {"u1", "new"}
    assert {r.doc_id: r.copies for r in later.state().collect()} == {"u0": 1, "u1": 3, "u2": 1, "u3": 1, "new": 1}
    stored = spark.read.parquet(later.content._batches().path_of(later.content.batches()[-1]))
    assert [r.doc_id for r in stored.collect()] == ["new"]


def test_stream_repeats_a_batch_that_failed(spark, tmp_path, monkeypatch):
    land(spark, tmp_path / "landing", [(i, f"u{i}", page("May 2001")) for i in range(3)])
    run = PageIngest(spark, str(tmp_path / "landing"), str(tmp_path / "s"), AT)
    whole = PageIngest._process

    def dies(self, arrivals, batch_id):
        arrivals.write.mode("overwrite").parquet(f"{self.root}/arrivals/batch={batch_id:010d}")
        raise RuntimeError("lost between state and content")

    monkeypatch.setattr(PageIngest, "_process", dies)
    with pytest.raises(Exception, match="lost between"):
        run.run()
    monkeypatch.setattr(PageIngest, "_process", whole)
    run.run()
    assert sorted(r.doc_id for r in run.registry().collect()) == ["u0", "u1", "u2"] and run.content.read().count() == 3
    assert {r.copies for r in run.state().collect()} == {1}


def test_state_files(spark, tmp_path):
    path = tmp_path / "state.json"
    path.write_text(json.dumps({"last_update": "2024-01-01", "essays": {
        "a.html": {"essay_id": "other", "title": "A \"q\"", "url": "u", "date": "2001-01-01", "raw_date_str": "", "read": True, "last_seen": "2024-01-02T03:04:05.678901"},
        "b.html": {}}}))
    rows = registry_json.read_state(spark, str(path)).orderBy("first_pos").collect()
    assert [(r.doc_id, r.title, r.url, r.date, r.raw_date_str, r.read) for r in rows] == [
        ("a.html", 'A "q"', "u", "2001-01-01", "", True), ("b.html", "", "", None, None, False)]
    assert rows[0].last_seen == dt.datetime(2024, 1, 2, 3, 4, 5, 678901)
    bad = tmp_path / "bad.json"
    bad.write_text("{not json")
    assert registry_json.read_state(spark, str(bad)).count() == 0
    known = registry_json.read_state(spark, str(path))
    registry_json.write_state(known, str(tmp_path / "out"), AT)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    state = json.loads(text)
    assert state["last_update"] == AT.isoformat() and list(state["essays"]) == ["a.html", "b.html"]
    assert state["essays"]["a.html"]["essay_id"] == "a.html" and state["essays"]["b.html"]["date"] is None
    back = registry_json.read_state_parts(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, known.drop("first_pos").collect()))


def test_versions_and_reset(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), registry.SCHEMA)
    assert table.read().isEmpty() and table.versions() == []
    one = spark.createDataFrame([("a", "A", "u", None, None, False, None, 0)], registry.SCHEMA)
    assert table.write(one) == 1 and table.read().count() == 1
    (tmp_path / "t" / "v=0000000002").mkdir()  # a write that never finished
    assert table.versions() == [1] and table.read().count() == 1
    assert table.clear() == 1 and table.read().isEmpty() and table.read(1).count() == 1


def test_content_store_and_interchange(spark, tmp_path):
    store = content_store.ContentStore(spark, str(tmp_path / "c"))
    rows = [("a/b.html", "u", "T", "a_b", "<p>x</p>", 1, None, None, [("f.png", b"\x00\xff" * 60)])]
    content = spark.createDataFrame(rows, content_store.SCHEMA)
    store.append(content, 1)
    store.append(content, 1)
    assert store.read().count() == 1
    content_store.write_json_entries(store.read(), str(tmp_path / "json"))
    back = content_store.read_json_entries(spark, str(tmp_path / "json" / "*.json")).first()
    assert (back.doc_id, back.content_html) == ("a/b.html", "<p>x</p>") and bytes(back.images[0].data) == b"\x00\xff" * 60
    (tmp_path / "json" / "broken.json").write_text("{")
    assert content_store.read_json_entries(spark, str(tmp_path / "json" / "*.json")).count() == 1
    assert content_store.file_stats(spark, str(tmp_path / "json" / "broken.json")).first()[:2] == (1, 1)
    assert store.new_generation("test") == 1 and store.read().isEmpty()


def test_stats_round_half_even(spark):
    df = spark.createDataFrame([("x" * int(1048576 * 0.125),)], "content_html string")
    assert incremental.stats(df).first().mb == 0.12


def test_bucketed_tables_join_without_shuffle(spark):
    spark.sql("DROP TABLE IF EXISTS b_docs")
    spark.sql("DROP TABLE IF EXISTS b_content")
    docs = spark.range(1000).selectExpr("cast(id as string) as doc_id", "repeat('x', 50) as html")
    write_bucketed(docs, "b_docs", "doc_id", 4)
    write_bucketed(docs.select("doc_id").limit(400), "b_content", "doc_id", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = incremental.missing(spark.table("b_docs"), spark.table("b_content"))
        assert "Exchange" not in left._jdf.queryExecution().executedPlan().toString()
        assert left.count() == 600
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_failed_fetches_are_left_out(spark, tmp_path):
    rows = [(1, "u", None), (2, "u", " \n"), (3, "u", "<p>x")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "p"))
    assert [r.page_id for r in read_pages(spark, str(tmp_path / "p")).collect()] == [3]
