import os

import pytest

import __spark_entry__ as entry
from check_sql import compare, duck

SF = "/root/testdata/sf0.001"
QUICK = ("agg_users", "agg_hours", "find_blocks", "score_full", "agg_per_topic", "store_append")

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables not present")


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    ok, text = compare(spark, duck(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, text


@needs_data
def test_entry(spark):
    df = entry.entry(spark)
    assert "summary_hash" in df.columns and df.count() > 0
