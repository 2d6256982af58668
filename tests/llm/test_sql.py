"""Queries of this round that SQL can express, against it."""

import pytest
from oracle_check import compare, duck_connect

from blotter.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op5_warc", "op11_filters", "op12_conversations"])
def test_query_matches_sql(spark, name):
    ok, msg = compare(queries.QUERIES[name](spark, SF), duck_connect(SF), queries.ORACLE[name])
    assert ok, msg
