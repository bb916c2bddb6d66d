"""Keyed tables in hash partitions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quire.operators import registry
from quire.sources.hashed import PART, Registry

AT = dt.datetime(2024, 3, 1, 12)
SOURCE = "doc_id string, title string, url string, date string, raw_date_str string, pos bigint"


def files(root):
    return {p.parent.name: (p.name, p.stat().st_mtime_ns) for p in root.glob(f"{PART}=*/*.parquet")}


@pytest.fixture()
def table(spark, tmp_path):
    rows = [(f"d{i}", f"T{i}", f"u{i}", None, "", False, None, i) for i in range(300)]
    table = Registry(spark, str(tmp_path / "r"), parts=16)
    table.replace(spark.createDataFrame(rows, registry.SCHEMA))
    return table


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_an_upsert_leaves_other_partitions_alone(spark, tmp_path, table):
    before, known = files(tmp_path / "r"), spark.createDataFrame(table.read().collect(), registry.SCHEMA)
    source = spark.createDataFrame(
        [("d7", "New", "n", "2001-01-01", None, 5), ("x1", "X", "x", None, None, 1), ("d7", "Last", "n", None, "Jan", 9)], SOURCE
    )
    touched = table.upsert(source, AT)
    after = files(tmp_path / "r")
    assert 1 <= len(touched) <= 2
    assert {k for k in after if after[k] != before.get(k)} == {f"{PART}={n}" for n in touched}
    assert all(len(list((tmp_path / "r" / k).glob("*.parquet"))) == 1 for k in after)
    want = registry.upsert(known, source, AT)
    assert rows_of(table.read()) == rows_of(want) and table.read().count() == 301
    assert table.read().where("doc_id = 'x1'").first().first_pos == 301  # behind all, also those of other partitions
    again = rows_of(table.read())
    table.upsert(source, AT)  # repeated: the same rows
    assert rows_of(table.read()) == again


def test_marks_touch_their_partitions_only(spark, tmp_path, table):
    before = files(tmp_path / "r")
    ids = spark.createDataFrame([("d3",), ("d3",), ("unknown",)], "doc_id string")
    touched = table.mark(ids, True)
    after = files(tmp_path / "r")
    assert {k for k in after if after[k] != before[k]} <= {f"{PART}={n}" for n in touched} and len(touched) <= 2
    assert [r.doc_id for r in table.read().where("read").collect()] == ["d3"]
    table.mark(ids, False)
    assert table.read().where("read").count() == 0
    assert table.mark(ids.limit(0), True) == [] and table.upsert(spark.createDataFrame([], SOURCE), AT) == []
    assert table.read().count() == 300


def test_single_rows_read_one_partition(spark, table):
    found = table.get(["d5"])
    assert [r.title for r in found.collect()] == ["T5"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [(part" in plan or "PartitionFilters: [part" in plan
    assert sorted(r.doc_id for r in table.get(["d5", "d6", "none"]).collect()) == ["d5", "d6"]


def test_a_new_table_and_null_keys(spark, tmp_path):
    table = Registry(spark, str(tmp_path / "new"), parts=4)
    assert table.read().count() == 0
    source = spark.createDataFrame([("a", "A", "u", None, None, 0), (None, "N", "u", None, None, 1)], SOURCE)
    table.upsert(source.where(F.col("doc_id").isNotNull()), AT)
    assert [(r.doc_id, r.first_pos) for r in table.read().collect()] == [("a", 0)]
