"""Rolling features and a moving baseline on a stream, from state kept for each app."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship_package

HOUR, WEEK = 3600, 168
OUTPUT = ("appid string, hour timestamp, n_rows bigint, n_rolling bigint, mean_rolling double, negative_rolling double, "
          "baseline double, is_volume_alert boolean")


def with_state_store(spark: SparkSession) -> SparkSession:
    """Choose the state store that keyed list and map states need, before a query with them starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def closed_hours(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Counts and sums per app and hour, once the watermark has passed the hour; later rows are dropped.

    Rows are summed up before they are shuffled, so an app of any size is one row an hour for what follows.
    """
    rows = events.withWatermark("ts", delay).groupBy("appid", F.window("ts", "1 hour").alias("w"))
    return rows.agg(
        F.count("*").alias("n"), F.sum("score").alias("total"), F.count_if(F.col("score") < 0).alias("negative"),
    ).select("appid", F.unix_seconds("w.start").alias("at"), "n", "total", "negative")


class HourlyTrends(StatefulProcessor):
    """Keeps the hours of the rolling window in a list and a decayed count for each hour of the week in a map.

    Hours arrive once each and in order of time. Both states are bounded: by the window, and by the 168 hours of a week. An app's
    state stays for as long as the query. The baseline of an hour is the mean of the same hour in earlier weeks, a week counting ``decay``
    times as much as the next; it is read before the hour itself is added, and there is none in the first week of an app.
    """

    def __init__(self, hours: int, decay: float, factor: float):
        self.hours, self.decay, self.factor = hours, decay, factor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "at bigint, n bigint, total double, negative bigint")
        self.slots = handle.getMapState("slots", "slot int", "decayed double, week bigint")
        self.since = handle.getValueState("since", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("at")
        since = int(self.since.get()[0]) if self.since.exists() else int(new["at"].iloc[0])
        recent, out = [tuple(r) for r in self.recent.get()], []
        for at, n, total, negative in new[["at", "n", "total", "negative"]].itertuples(index=False):
            at, n = int(at), int(n)
            recent = [r for r in recent if r[0] > at - self.hours * HOUR] + [(at, n, float(total), int(negative))]
            rolled = sum(r[1] for r in recent)
            hour = at // HOUR
            slot, week = hour % WEEK, hour // WEEK
            decayed, last = (self.slots.getValue((slot,)) if self.slots.containsKey((slot,)) else (0.0, week))
            decayed *= self.decay ** (week - last)  # as of this week, weeks without rows included
            weeks = (at - since) // (WEEK * HOUR)
            weight = sum(self.decay ** k for k in range(1, weeks + 1))
            baseline = decayed / weight if weeks else None
            self.slots.updateValue((slot,), (decayed + n, week))
            out.append((key[0], pd.Timestamp(at, unit="s"), n, rolled, sum(r[2] for r in recent) / rolled,
                        sum(r[3] for r in recent) / rolled, baseline, bool(weeks and n > self.factor * baseline)))
        self.recent.put(recent)
        self.since.update((since,))
        yield pd.DataFrame(out, columns=["appid", "hour", "n_rows", "n_rolling", "mean_rolling", "negative_rolling", "baseline", "is_volume_alert"])

    def close(self) -> None:
        pass


def hourly_trends(events: DataFrame, hours: int = 24, decay: float = 0.5, factor: float = 3.0, delay: str = "1 hour") -> DataFrame:
    """Each closed hour of a stream of ``appid``, ``ts``, ``score`` with rolling count, mean and negative share, baseline and alert.

    Only the past counts: an hour is judged by hours that ended before it. Hours with no rows are not reported.
    """
    ship_package(with_state_store(events.sparkSession))
    return closed_hours(events, delay).groupBy("appid").transformWithStateInPandas(
        statefulProcessor=HourlyTrends(hours, decay, factor), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
