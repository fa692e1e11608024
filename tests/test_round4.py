"""Findings of the third review: values that small tables happen not to hold, and growth."""

import os

import duckdb
import pytest

from patchpulse.catalog import REGISTRY
from patchpulse.catalog.checks import TABLES, compare, connect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def idle_reviews(tmp_path_factory):
    """The smallest tables, with authors who had not played at all when they wrote (also as a negative zero)."""
    path = tmp_path_factory.mktemp("idle")
    for t in TABLES:
        if t != "events":
            os.symlink(f"{SMALL}/{t}.parquet", path / f"{t}.parquet")
    duckdb.sql(f"""COPY (SELECT * REPLACE (CASE WHEN event_id % 35 = 5 THEN 0.0::DOUBLE WHEN event_id % 35 = 10 THEN -0.0::DOUBLE ELSE value END AS value)
                   FROM '{SMALL}/events.parquet') TO '{path}/events.parquet'""")
    return str(path)


def test_payloads_of_authors_without_playtime_at_review(spark, idle_reviews):
    q = REGISTRY["review_payloads"]
    assert compare(q.run(spark, idle_reviews).toPandas(), connect(idle_reviews).sql(q.sql).df()) is None
