"""Operators whose digest columns SQL can express, against that SQL on the smallest tables."""

import pytest

from patchpulse.catalog.checks import compare, connect
from patchpulse.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op5_benchmark_decontamination", "op9_substring_dedup", "op11_suffix_dedup"])
def test_operator_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    assert len(got) and compare(got, connect(SMALL).sql(queries.SQL[name]).df()) is None
