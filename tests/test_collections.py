import datetime as dt

import pytest
from pyspark.sql import functions as F

from quire.operators import chapters, ranking
from quire.operators.ranking import Key, numbered, numbered_by_range, numbered_by_window
from quire.rules import DEFAULT
from quire.sources.pages import read_chapters, write_collection


SCHEMA = "doc_id string, collection string, date string, raw_date_str string, title string, read boolean, first_pos bigint"


DOCUMENTS = [  # id, date, title, read
    ("a", "2001-01-01", "B", False),
    ("b", "2003-05-01", "A", True),
    ("c", None, "Z", False),
    ("d", "", "A", True),
    ("e", "2001-01-01", "A", True),
    ("f", "2001-01-01", "A", False),
    ("g", "2001-01-01", "A", False),
    ("h", None, "A", False),
]


def documents(spark):
    """The same documents in two collections, the ids of the second in capitals."""
    rows = [(i, "one", d, None, t, r, n) for n, (i, d, t, r) in enumerate(DOCUMENTS)]
    rows += [(i.upper(), "two", *rest) for i, _, *rest in rows]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("order, ids", [("asc", "fgeabhdc"), ("desc", "bafgehdc")])
@pytest.mark.parametrize("by_range", [False, True])
def test_reading_order(spark, order, ids, by_range):
    found = chapters.spine(documents(spark).repartition(7), order=order, exact_parallel=by_range).collect()
    for collection, expected in (("one", ids), ("two", ids.upper())):
        assert [(r.ordinal, r.doc_id) for r in sorted(r for r in found if r.collection == collection)] == [*enumerate(expected, 1)]


@pytest.mark.parametrize("order, ids", [("asc", "afgebhdc"), ("desc", "chdbafge")])
def test_reversible_order(spark, order, ids):
    ours = documents(spark).where("collection = 'one'").orderBy(*chapters.reversible_order(order)).collect()
    assert "".join(r.doc_id for r in ours) == ids


def test_numbers_do_not_depend_on_partitions(spark):
    """One group holds nearly all rows, most of them tied on the leading key."""
    df = spark.range(5000).select(
        F.when(F.col("id") % 100 == 0, "small").otherwise("big").alias("g"), (F.col("id") % 3).alias("k"), "id"
    )
    seen = []
    for parts in (1, 5):
        got = numbered(df.repartition(parts), [F.col("g")], [Key(F.col("k"), True), Key(F.col("id"))], "n", True).collect()
        seen.append({(r.g, r.id): r.n for r in got})
    assert seen[0] == seen[1]
    big = sorted(((r[0][1] % 3, r[0][1]) for r in seen[0].items() if r[0][0] == "big"), key=lambda t: (-t[0], t[1]))
    assert [seen[0]["big", i] for _, i in big] == list(range(1, len(big) + 1))


def test_ranges_equal_the_window_on_nulls_and_both_ways(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("g"), (F.col("id") % 2).cast("string"))).alias("g"),
        F.when(F.col("id") % 5 > 0, F.sha2((F.col("id") % 40).cast("string"), 256)).alias("a"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 11).alias("b"), "id",
    )
    order = [Key(F.col("a"), True), Key(F.col("b")), Key(F.col("id"), True)]
    want = {r.id: r.n for r in numbered_by_window(df, [F.col("g")], order, "n").collect()}
    for ranges in (1, 3, 40, 200):
        assert {r.id: r.n for r in numbered_by_range(df, [F.col("g")], order, "n", ranges).collect()} == want
    assert numbered_by_range(df.limit(0), [F.col("g")], order, "n").collect() == []


def test_ranges_of_one_hot_group_are_even_and_cost_no_job_beforehand(spark):
    """All rows in one group, nearly all in one leading key."""
    df = spark.range(40_000).select(F.lit("all").alias("g"), (F.col("id") % 50 == 0).alias("k"), F.xxhash64("id").alias("h"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("numbering", "")
    ranked = numbered_by_range(df, [F.col("g")], [Key(F.col("k"), True), Key(F.col("h"))], "n", 32)
    assert not tracker.getJobIdsForGroup("numbering")
    spark.sparkContext.setJobGroup("rest", "")
    sizes = ranking_ranges(df, [F.col("g")], [Key(F.col("k"), True), Key(F.col("h"))], 32)
    assert sum(sizes) == 40_000 and len(sizes) >= 28 and max(sizes) < 3 * 40_000 / 32
    assert ranked.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first() == (1, 40_000, 40_000)
    assert "ExistingRDD" not in ranked._jdf.queryExecution().executedPlan().toString()


def ranking_ranges(df, group, order, ranges):
    """Rows of each range."""
    names = [f"__key{i}" for i in range(len(group) + len(order))]
    placed = ranking.placed_in_ranges(df, [*map(Key, group), *order], names, ranges)
    return [r["count"] for r in placed.groupBy("__range").count().collect()]


def test_order_is_validated(spark):
    with pytest.raises(ValueError):
        chapters.collection_order("newest")
    assert chapters.check_order("asc") == "asc"


def test_chapters(spark):
    long = "<p>" + "Salt marshes keep the tide out of the fields. " * 9 + "</p>"
    df = spark.createDataFrame(
        [("a/b.html", "Tom & J", "2011-06-01", "June 2011", False, 0, long), ("s", "Short", None, "", False, 1, "<p>Short</p>"),
         ("n", "None", None, "", True, 2, "<p>" + "x" * 100 + "</p>"), ("m", "Less", None, "", True, 3, "<p>" + "x" * 99 + " </p>")],
        "doc_id string, title string, date string, raw_date_str string, read boolean, first_pos bigint, content_html string",
    )
    made = {r.doc_id: r for r in chapters.build_chapters(df).collect()}
    assert set(made) == {"a/b.html", "n"}
    first = made["a/b.html"]
    assert first.chapter_id == "essay_a_b" and first.chapter_title == "Tom & J (June 2011)"
    assert "<h1>Tom &amp; J</h1>" in first.html and '<p class="essay-date">June 2011</p>' in first.html
    assert made["n"].chapter_title == "None" and "essay-date" not in made["n"].html


def test_spine_toc_and_metadata(spark):
    df = spark.createDataFrame([("x", "c", "2001-01-01", None, "X", False, 0), ("y", "c", None, None, "Y", False, 1)], SCHEMA)
    df = df.withColumns({"chapter_id": F.concat(F.lit("essay_"), "doc_id"), "chapter_title": F.col("title")})
    spine = chapters.spine(df)
    items = chapters.spine_items(spine, cover=True).orderBy("position").collect()
    assert [(r.position, r.item) for r in items] == [(0, "cover"), (1, "nav"), (2, "essay_x"), (3, "essay_y")]
    toc = chapters.toc(df, spine).orderBy("ordinal").collect()
    assert [(r.section, r.title, r.file_name) for r in toc] == [("Essays", "X", "essay_x.xhtml"), ("Essays", "Y", "essay_y.xhtml")]
    rules = DEFAULT.but(collection_title="Readings", identifier_prefix="r")
    row = chapters.with_metadata(spark.range(1), dt.date(2024, 2, 9), rules).first()
    assert (row.identifier, row.title, row.language) == ("r-20240209", "Readings - 2024-02-09", "en")


def test_clashing_keys(spark):
    df = spark.createDataFrame([("a/b.html",), ("a_b.html",), ("c",)], "doc_id string")
    assert [(r.safe_key, r.n_docs) for r in chapters.clashing_keys(df).collect()] == [("a_b", 2)]


def test_empty_bodies_are_left_out_where_the_gate_is_open(spark):
    rows = [("a", "", '<img src="x.png"/>'), ("b", "T", '<img src="x.png"/>'), ("c", "", "seen"), ("d", "", " ")]
    df = spark.createDataFrame([(d, t, None, None, False, 0, c) for d, t, c in rows],
        "doc_id string, title string, date string, raw_date_str string, read boolean, first_pos long, content_html string")
    made = chapters.build_chapters(df, DEFAULT.but(min_chapter=0))
    assert sorted(r.doc_id for r in made.collect()) == ["b", "c", "d"]  # d says that it has no content


def test_written_chapters_lie_in_reading_order(spark, tmp_path):
    n = 95
    made = spark.range(n).selectExpr("cast(id as string) doc_id", "if(id < 90, 'big', 'small') collection", "repeat('x', 10) html")
    order = spark.range(n).selectExpr("cast(id as string) doc_id", "if(id < 90, 'big', 'small') collection", "if(id < 90, 90 - id, id - 89) ordinal")
    root = str(tmp_path / "book")
    write_collection(made, order, order, order.limit(1), root, chapters_a_part=10)
    parts = spark.read.parquet(f"{root}/chapters").groupBy("collection", "part").agg(
        F.count("*").alias("n"), F.count_distinct("_metadata.file_path").alias("files"), F.max("ordinal").alias("last"))
    assert {(r.collection, r.part, r.n, r.files, r.last) for r in parts.collect()} == {
        *[("big", k, 10, 1, 10 * k + 10) for k in range(9)], ("small", 0, 5, 1, 5)}
    book = read_chapters(spark, root, "big", chapters_a_part=10)
    streamed = [r.ordinal for k in range(9) for r in book.where(f"part = {k}").toLocalIterator()]
    assert streamed == list(range(1, 91))
    some = read_chapters(spark, root, "big", 12, 19, chapters_a_part=10)
    assert [(r.doc_id, r.ordinal) for r in some.collect()] == [(str(90 - k), k) for k in range(12, 20)]
    filters = some._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "part#" in filters and "collection#" in filters
    write_collection(made.withColumn("collection", F.lit("007")), order.withColumn("collection", F.lit("007")), order, order.limit(1), root)
    assert read_chapters(spark, root, "007").count() == n


def test_keys_of_chapters_shuffle_no_text(spark, tmp_path):
    """What order and contents need of the collections is planned without text in any shuffle, and without a join with itself."""
    from quire.catalog.collection_queries import _collections

    made = _collections(spark, "/root/testdata/sf0.001")
    assert "html" in made.columns and "collection" in made.columns
    plan = made.select("collection", "doc_id", "date", "title", "read", "first_pos", "chapter_title")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) == 3  # orders, labels, documents
    above = plan.split("Generate")[0]
    assert "content_html" not in above


def test_chapters_are_gated_by_the_length_measured_where_texts_are_read(spark, tmp_path):
    from quire.catalog.collection_queries import _collections, _content
    from quire.operators.content import content_length

    docs = _content(spark, "/root/testdata/sf0.001", measured=True)
    assert docs.where(F.col("n_chars") != content_length(F.col("content_html"))).count() == 0
    want = {r.doc_id for r in docs.where(content_length(F.col("content_html")) >= DEFAULT.min_chapter).select("doc_id").collect()}
    assert {r.doc_id for r in _collections(spark, "/root/testdata/sf0.001").select("doc_id").collect()} == want
