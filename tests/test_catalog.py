"""A quick part of the catalogue against its SQL on the smallest tables, and completeness of the item list."""

import re

import pytest

from patchpulse.catalog import REGISTRY
from patchpulse.catalog.checks import compare, connect

SMALL = "/root/testdata/sf0.001"
QUICK = (
    "impact_report", "review_windows", "exclusion_reasons", "comment_prefilter", "nearest_comment_source", "store_summary",
    "latest_patch_alignment", "news_window_stats", "rolling_sentiment", "trend_changes", "hourly_monitor", "backtest",
    "detected_updates", "new_reviews", "ingested_comments", "evaluation", "coordinated_groups", "joint_vocabulary",
    "cased_sentiment", "stream_news_windows",
)
ITEMS = (
    [f"S{i}" for i in range(1, 17)] + [f"F{i}" for i in range(1, 11)] + [f"C{i}" for i in range(1, 9)]
    + [f"X{i}" for i in range(1, 17)] + [f"J{i}" for i in range(1, 12)] + [f"G{i}" for i in range(1, 19)]
    + [f"W{i}" for i in range(1, 13)] + [f"K{i}" for i in range(1, 5)] + [f"U{i}" for i in range(1, 4)]
    + [f"R{i}" for i in range(1, 18)] + [f"A{i}" for i in range(1, 6)] + [f"M{i}" for i in range(1, 10)]
    + [f"L{i}" for i in range(1, 6)] + [f"T-{i}" for i in range(1, 5)]
)


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    q = REGISTRY[name]
    assert compare(q.run(spark, SMALL).toPandas(), con.sql(q.sql).df()) is None


def test_every_item_has_a_query():
    covered = set()
    for q in REGISTRY.values():
        for part in q.ids.split(", "):
            m = re.fullmatch(r"([A-Z])(\d+)-[A-Z](\d+)", part)
            covered |= {f"{m[1]}{i}" for i in range(int(m[2]), int(m[3]) + 1)} if m else {part}
    assert [i for i in ITEMS if i not in covered] == []
