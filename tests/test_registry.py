import datetime as dt

import pytest

from quire.operators import registry
from quire.rules import DEFAULT

AT = dt.datetime(2024, 1, 1)


def known(spark, rows):
    return spark.createDataFrame([(*r, None, i) for i, r in enumerate(rows)], registry.SCHEMA)


@pytest.fixture()
def base(spark):
    return known(
        spark,
        [("a", "Beating the Averages", "u", "2001-04-01", "April 2001", True), ("b", "How to Work Hard", "u", None, "", False),
         ("c", "100% sure_thing", "u", "", None, False)],
    )


def source(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, title string, url string, date string, raw_date_str string, pos bigint")


def test_upsert(spark, base):
    new = source(spark, [("a", "New title", "v", None, "", 0), ("d", "D", "w", None, "", 1), ("d", "D again", "w", "1999-01-01", "1999", 2)])
    rows = {r.doc_id: r for r in registry.upsert(base, new, AT).collect()}
    assert (rows["a"].title, rows["a"].date, rows["a"].raw_date_str, rows["a"].read) == ("New title", "2001-04-01", "April 2001", True)
    assert (rows["d"].title, rows["d"].date, rows["d"].read, rows["d"].first_pos) == ("D again", "1999-01-01", False, 4)
    assert rows["a"].last_seen == AT and rows["b"].last_seen is None and rows["c"].raw_date_str is None
    compat = {r.doc_id: r for r in registry.upsert(base, new, AT, DEFAULT.but(compat=True)).collect()}
    assert compat["a"].raw_date_str == "" and compat["a"].date == "2001-04-01"


def test_upsert_into_nothing_and_again(spark):
    new = source(spark, [("x", "X", "u", None, "", 5), ("y", "Y", "u", None, "", 3)])
    once = registry.upsert(registry.empty_registry(spark), new, AT)
    assert [r.doc_id for r in registry.all_documents(once).collect()] == ["y", "x"]
    twice = registry.upsert(once, new, AT)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_marks(spark, base):
    ids = spark.createDataFrame([("a",), ("b",), ("b",), ("nowhere",)], "doc_id string")
    assert registry.marked_count(base, ids).first().n_marked == 3
    assert {r.doc_id: r.read for r in registry.mark_read(base, ids).collect()} == {"a": True, "b": True, "c": False}
    assert {r.doc_id: r.read for r in registry.mark_unread(base, ids).collect()} == {"a": False, "b": False, "c": False}


def test_search(spark, base):
    assert [r.doc_id for r in registry.find_by_title(base, "averages").collect()] == ["a"]
    assert [r.doc_id for r in registry.find_by_title(base, "0%").collect()] == ["c"]
    assert [r.doc_id for r in registry.find_by_title(base, "e_t").collect()] == ["c"]
    report = registry.match_report(base, ["HARD", "zzz", "in", "in"]).collect()
    assert {r.query: r.n_hits for r in report} == {"HARD": 1, "zzz": 0, "in": 2}
    targets = registry.target_ids(base, ["b", "q"], ["hard", "aver"])
    assert {r.doc_id for r in targets.collect()} == {"a", "b", "q"}
    assert {r.title for r in registry.marked_titles(base, targets).collect()} == {"Beating the Averages", "How to Work Hard"}
    with pytest.raises(ValueError):
        registry.target_ids(base)


def test_filters_and_listing(spark, base):
    assert {r.doc_id for r in registry.unread_documents(base).collect()} == {"b", "c"}
    assert {r.doc_id for r in registry.read_documents(base).collect()} == {"a"}
    assert registry.get_document(base, "b").first().title == "How to Work Hard"
    both = registry.listed(base, unread_only=True, read_only=True)
    assert {r.doc_id for r in both.collect()} == {"b", "c"}
    lines = [r.line for r in registry.listing(base).collect()]
    assert lines == [
        f"[UNREAD] {'How to Work Hard':50} | {'Unknown date':15} | b",
        f"[UNREAD] {'100% sure_thing':50} | {'Unknown date':15} | c",
        f"[READ]   {'Beating the Averages':50} | {'April 2001':15} | a",
    ]
    assert tuple(registry.counts(base).first()) == (3, 2, 1)
