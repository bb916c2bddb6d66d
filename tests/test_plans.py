"""What the physical plans must look like at scale."""

import re

import pytest
from pyspark.sql import functions as F

from quire.operators import links, markup_rows, registry
from quire.operators.chapters import build_chapters
from quire.operators.content import extract_content, region_paragraphs
from quire.operators.page_dates import with_page_date
from quire.rules import DEFAULT


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def pages(spark, tmp_path):
    rows = [(1, "http://s.example/a", "<html><body><article><p>text</p></article></body></html>", "junk")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string, unused string").write.parquet(str(tmp_path / "p"))
    return spark.read.parquet(str(tmp_path / "p"))


def test_parsing_is_one_narrow_stage(pages):
    rules = DEFAULT.but(region_tags=("article",), nav_tags=("nav",))
    for df in (
        markup_rows.token_rows(pages),
        region_paragraphs(pages, rules=rules),
        links.document_links(pages),
        extract_content(pages.select("page_id", "html", F.lit("").alias("title")).transform(with_page_date), rules=rules),
    ):
        text = plan(df)
        assert "Exchange" not in text and "BatchEvalPython" not in text and "unused" not in re.findall(r"ReadSchema: (.*)", text)[0]


def test_markup_is_not_parsed_twice(pages):
    """A filter on parsed columns stays above the parse instead of being rewritten into the scan."""
    rules = DEFAULT.but(region_tags=("article",))
    filtered = region_paragraphs(pages, rules=rules).filter(F.size("paragraphs") > 3)
    assert plan(filtered).count("!--.*?-->") == 1


def test_content_gate_reaches_the_scan(spark, tmp_path):
    fields = "doc_id string, title string, date string, raw_date_str string, read boolean, first_pos bigint, content_html string, n_chars int"
    spark.createDataFrame([("a", "A", None, None, False, 0, "x", 1)], fields).write.parquet(str(tmp_path / "c"))
    keys = build_chapters(spark.read.parquet(str(tmp_path / "c"))).select("doc_id", "date", "title")
    assert "GreaterThanOrEqual(n_chars,100)" in plan(keys) and "content_html" not in plan(keys)


def test_lookups_are_pushed_down_and_searches_do_not_join(spark, tmp_path):
    spark.createDataFrame([("a", "A", "u", None, None, False, None, 0)], registry.SCHEMA).write.parquet(str(tmp_path / "r"))
    known = spark.read.parquet(str(tmp_path / "r"))
    assert "EqualTo(doc_id,a)" in plan(registry.get_document(known, "a"))
    searched = plan(registry.title_matches(known, ["a", "b"]))
    assert "Join" not in searched and "Exchange" not in searched
