import os

import pytest

import corpus_pipeline
from quire.llm import registry
from quire.catalog.check import compare, database

SMALL = "/root/testdata/sf0.001"


def test_stages_on_odd_rows(spark, documents, odd, tmp_path, prose):
    root = str(tmp_path)
    long = prose(80)
    rows = [(1, long), (2, long + " one more"), (3, prose(60) + " " + prose(30)), (4, None), *odd]
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, " ".join(rows[2][1].split()[10:50]))], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    docs = documents(rows)
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    stages = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "line_dedup", "near_dedup", "decontamination"):
        out = stages[name](spark, docs, root)
        assert out.columns == docs.columns
        assert stages[name](spark, documents([]), root).count() == 0
    assert ids(stages["near_dedup"](spark, docs, root)) == {None, 1, 3, 4, 93, 94, 95, 96}
    assert ids(stages["decontamination"](spark, docs, root)) == {i for i, _ in rows} - {3}
    assert stages["packing"](spark, docs, root).select("doc_id").distinct().count() == len({i for i, _ in rows})


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


@pytest.mark.parametrize("name", sorted(registry.all_sql()))
def test_queries_agree_with_sql(spark, name):
    if not os.path.isdir(SMALL):
        pytest.skip("no test data")
    assert compare(spark, database(SMALL), registry.all_queries()[name], registry.all_sql()[name], SMALL) == ""
