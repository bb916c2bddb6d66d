"""The registered queries against their SQL on the smallest driver data, where it is there."""

import os
import re

import pytest

import __spark_entry__ as contract
from quire.catalog import check

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = ("T1_tokens", "T2_stripped_text", "L5_first_links", "B4_main_region", "P2_P9_kept_paragraphs", "C7_reading_order_by_ranges",
          "M1_upsert", "M14_listing_lines", "N1_missing_and_merged", "E1_region_paragraphs")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver data not there")


def test_every_sql_belongs_to_a_query_and_is_valid():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    con = check.database(SF_DIR)
    for name, sql in contract.oracle_sql().items():
        con.execute(f"EXPLAIN {sql}")
        assert re.match(r"^(SRC|SNK|op|[TLDBPCIMNE])\d+_|^pipeline$", name)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    assert check.compare(spark, check.database(SF_DIR), contract.queries()[name], contract.oracle_sql()[name], SF_DIR) == ""


def test_flagship(spark):
    assert contract.entry(spark).columns == ["page_id", "n_paragraphs", "n_chars"]
