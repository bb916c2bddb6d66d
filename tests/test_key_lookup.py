"""Key tests that skip row groups."""

from pyspark.sql import functions as F

from quire.operators import incremental, registry
from quire.sources.content_store import SCHEMA, ContentStore
from quire.sources.hashed import Registry
from quire.sources.key_lookup import few_keys, is_one_of, narrowed


def rows_read(df):
    """Rows that the scan of ``df`` hands on."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def store_of(spark, root, n_batches, n_rows):
    """Batches whose keys all span the whole range, so that only Bloom filters can tell them apart."""
    store = ContentStore(spark, root)
    for batch in range(n_batches):
        rows = spark.range(n_rows).select(F.sha2(F.concat_ws("-", F.lit(batch), "id"), 256).alias("doc_id"), F.lit("<p>x</p>").alias("content_html"))
        known = set(rows.columns)
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], SCHEMA).schema if f.name not in known]
        store.append(rows.select("*", *empty).coalesce(1))
    return store


def test_a_few_keys_read_the_row_groups_that_hold_them(spark, tmp_path):
    store = store_of(spark, str(tmp_path / "c"), 8, 500)
    keys = [r.doc_id for r in store.read().orderBy("doc_id").limit(2000).collect()][1000:1001]
    docs = spark.createDataFrame([(k,) for k in [*keys, "8" * 64, None]], "doc_id string")
    asked = store.read_for(docs)
    assert [r.doc_id for r in asked.collect()] == keys
    assert rows_read(store.read_for(docs).select("doc_id")) == 500  # of 4,000
    many = store.read().limit(600).select("doc_id")
    assert rows_read(store.read_for(many).select("doc_id")) == 4000 and few_keys(many, "doc_id") is None
    thirty = [(r.doc_id,) for r in store.read().where("_metadata.file_path like '%v=0000000003%'").limit(30).collect()]
    thirty = spark.createDataFrame(thirty, "doc_id string")
    assert rows_read(store.read_for(thirty).select("doc_id")) == 500  # a longer list than Spark pushes by itself


def test_joins_give_the_same_rows_either_way(spark, tmp_path):
    store = store_of(spark, str(tmp_path / "c"), 2, 60)
    ids = [r.doc_id for r in store.read().collect()][:50]
    docs = spark.createDataFrame([(i,) for i in [*ids, ids[0], "none", "", None]], "doc_id string")
    for join in (incremental.is_stored, incremental.missing):
        want = sorted(map(str, join(docs, store.read()).collect()))
        for most in (5, 500):
            assert sorted(map(str, join(docs, narrowed(store.read(), docs, most=most)).collect())) == want
    assert store.read_for(docs.limit(0)).count() == 0
    assert spark.range(3).where(is_one_of(F.col("id"), [])).count() == 0
    assert ContentStore(spark, str(tmp_path / "none")).read_for(docs).count() == 0


def test_a_point_lookup_reads_one_partition(spark, tmp_path):
    table = Registry(spark, str(tmp_path / "r"), parts=8)
    table.replace(spark.createDataFrame([(f"d{i}", "t", "u", None, "", False, None, i) for i in range(800)], registry.SCHEMA))
    assert [r.doc_id for r in table.get(["d17", "none"]).collect()] == ["d17"]
    assert rows_read(table.get(["d17"]).select("doc_id")) < 200 and table.get([None]).count() == 0
