"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from patchpulse.catalog import REGISTRY
from patchpulse.session import local_session

HEADLINE = (
    "impact_report", "review_windows", "exclusion_reasons", "sentiment_scores", "topic_counts", "distribution_summary",
    "coverage_report", "nearest_comment_source", "latest_patch_alignment", "news_window_stats", "rolling_sentiment",
    "trend_changes", "risk_scores", "risk_thresholds", "hourly_monitor", "crisis_alerts", "trend_alerts", "backtest",
    "engagement_features", "coordinated_groups", "stream_monitor",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["impact_report"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in HEADLINE:
        if name not in REGISTRY:
            continue
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
