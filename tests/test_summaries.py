"""Mergeable hourly summaries and the interval join of news and comments on streams."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchpulse.operators import risk, summaries
from patchpulse.session import fresh_path
from patchpulse.streaming import jobs, news

START = dt.datetime(2024, 3, 4)


def test_summaries_of_any_window_stay_within_the_stated_errors(spark):
    # a third of all values are equal, one app holds most rows
    rows = spark.range(120_000).select(
        F.when(F.col("id") % 10 < 8, "big").otherwise("small").alias("appid"),
        (F.timestamp_seconds(F.lit(1709510400) + F.col("id") * 7 % 172_800)).alias("ts"),
        F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.abs(F.xxhash64("id")) % 100_000 / 1e4).alias("v"),
        (F.abs(F.xxhash64("id", F.lit(1))) % 30_000).alias("who"))
    rows = rows.unionByName(spark.createDataFrame([("big", START, None, 1), ("big", None, 1.0, 1)], rows.schema))
    stored = summaries.hourly_summaries(rows, "v", "who")
    assert stored.count() == 2 * 48 and stored.agg(F.sum("n")).first()[0] == 120_000
    daily = summaries.merged(stored, ["appid", F.to_date("hour").alias("day")])
    for r in summaries.described(summaries.merged(daily, ["appid"])).collect():  # summaries of summaries
        mine = rows.where((F.col("appid") == r.appid) & F.col("v").isNotNull() & F.col("ts").isNotNull()).toPandas()
        values = np.sort(mine["v"].to_numpy())
        assert r.n == len(values) and r.mean == pytest.approx(values.mean()) and r.sd == pytest.approx(values.std(ddof=1))
        for p, got in ((0.5, r.p50), (0.75, r.p75), (0.95, r.p95), (0.99, r.p99)):
            lowest, highest = np.searchsorted(values, got, "left") / len(values), np.searchsorted(values, got, "right") / len(values)
            assert lowest - 0.01 <= p <= highest + 0.01
        assert abs(r.n_people / mine["who"].nunique() - 1) < 0.04


def test_thresholds_from_summaries_equal_the_exact_ones_on_few_values(spark):
    rows = spark.createDataFrame([("a", START + dt.timedelta(minutes=i), float(i % 9) / 2, i) for i in range(360)] + [("b", START, 2.0, None)],
                                 "appid string, ts timestamp, risk_score double, who int")
    got = summaries.window_thresholds(summaries.hourly_summaries(rows, "risk_score", "who"), ["appid"])
    want = risk.derive_thresholds(rows, ["appid"])
    key = lambda df: sorted((r.appid, r.method, round(r.critical, 6), round(r.high, 6), round(r.medium, 6)) for r in df.collect())
    assert key(got) == key(want)
    assert summaries.window_thresholds(summaries.hourly_summaries(rows.limit(0), "risk_score", "who"), ["appid"]).count() == 0


def test_comments_after_news_on_two_streams(spark):
    def land(path, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    item, comment = "appid string, gid string, published_at timestamp", "appid string, ts timestamp, score double"
    at = lambda h: START + dt.timedelta(hours=h)
    n_path, c_path = fresh_path(spark, "n"), fresh_path(spark, "c")
    land(n_path, [("a", "g1", at(0)), ("a", "g2", at(20)), ("b", "g3", at(3)), (None, "g4", at(1))], item)
    land(c_path, [("a", at(0), 1.0), ("a", at(24), -1.0), ("a", at(24.1), 0.0), ("a", at(72), None), ("a", at(73), 0.5), (None, at(1), 1.0)], comment)
    land(n_path, [("a", "open", at(90)), ("z", "end", at(300))], item)
    land(c_path, [("z", at(300), 0.0)], comment)
    land(n_path, [("a", "late", at(1))], item)  # both far behind the watermark of the batch before
    land(c_path, [("a", at(2), 9.0)], comment)

    def run():
        out = news.news_windows_stream(jobs.read_stream(spark, n_path, item, 1), jobs.read_stream(spark, c_path, comment, 1))
        q = out.writeStream.format("parquet").option("path", f"{c_path}-out").option("checkpointLocation", f"{c_path}-state")
        q.outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return {r.gid: r for r in spark.read.schema(out.schema).parquet(f"{c_path}-out").collect()}, spark.read.parquet(f"{c_path}-out").count()

    got, n = run()
    assert n == len(got) and set(got) == {"g1", "g2", "g3", "open"}
    one, two = got["g1"], got["g2"]
    assert (one.count_in_24h, one.count_in_48h, one.count_in_72h) == (2, 3, 4)
    assert one.avg_sent_in_24h == 0 and one.neg_ratio_in_24h == 0.5 and one.pos_ratio_in_48h == pytest.approx(1 / 3)
    assert (two.count_in_24h, two.count_in_72h) == (2, 4)
    assert got["g3"].count_in_72h == 0 and got["g3"].avg_sent_in_72h is None
    again, n_again = run()  # from the checkpoint: nothing new, nothing twice
    assert n_again == n and set(again) == set(got)


def test_busy_app_is_answered_without_pairing_items_and_comments(spark):
    base = 1709510400  # 2024-03-04
    n = 3_000
    items = spark.range(n).select(F.lit("a").alias("appid"), F.col("id").cast("string").alias("gid"), F.timestamp_seconds(base + F.col("id") * 37 % 86_400).alias("published_at"))
    comments = spark.range(n).select(F.lit("a").alias("appid"), F.timestamp_seconds(base + F.col("id") * 91 % 300_000).alias("ts"),
                                     F.when(F.col("id") % 7 > 0, (F.col("id") % 5 - 2) / 2).alias("score"))
    end = dt.datetime(2024, 4, 1)
    items = items.unionByName(spark.createDataFrame([("z", "end", end)], items.schema))
    comments = comments.unionByName(spark.createDataFrame([("z", end, 0.0)], comments.schema))
    n_path, c_path = fresh_path(spark, "n"), fresh_path(spark, "c")
    items.coalesce(1).write.parquet(n_path)
    comments.coalesce(1).write.parquet(c_path)
    out = news.news_windows_stream(jobs.read_stream(spark, n_path, items.schema), jobs.read_stream(spark, c_path, comments.schema))
    q = out.writeStream.format("parquet").option("path", f"{c_path}-out").option("checkpointLocation", f"{c_path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.gid: r for r in spark.read.schema(out.schema).parquet(f"{c_path}-out").collect()}
    rows = sorted(((c.ts, c.score) for c in comments.where("appid = 'a'").collect()), key=lambda x: x[0])
    at, score = np.array([r[0].timestamp() for r in rows]), np.array([np.nan if r[1] is None else r[1] for r in rows])
    assert len(got) == n
    for i in items.where("appid = 'a' AND gid % 100 = 0").collect():
        p = i.published_at.timestamp()
        for w in (24, 48, 72):
            inside = (at >= p) & (at <= p + w * 3600)
            assert got[i.gid][f"count_in_{w}h"] == inside.sum()
            assert got[i.gid][f"avg_sent_in_{w}h"] == pytest.approx(np.nanmean(score[inside]), abs=1e-9)
            assert got[i.gid][f"neg_ratio_in_{w}h"] == pytest.approx((score[inside] < 0).sum() / (~np.isnan(score[inside])).sum())
    states = [s for p in q.recentProgress for s in p.stateOperators]
    assert not any("Join" in s.operatorName for s in states)
