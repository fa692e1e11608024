"""Comments in the hours after a news item, joined between two streams."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import config
from ..session import ship_package
from .trends import HOUR, with_state_store

BUCKET_HOURS = 24
MICRO = 1_000_000
PARTS = ("n", "scored", "total", "negative", "positive")
# The process that starts a keyed stream on the driver does not see shipped packages, so the processor travels with its code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _packed(rows: pd.DataFrame) -> bytes:
    batch, sink = pa.RecordBatch.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(blobs: Iterator[tuple]) -> pd.DataFrame | None:
    frames = [pa.ipc.open_stream(bytes(b[0])).read_pandas() for b in blobs]
    return pd.concat(frames, ignore_index=True) if frames else None


class WindowParts(StatefulProcessor):
    """Answers the items of one (app, bucket) from the sorted comments of that bucket: two binary searches a window, no pairs.

    The rows of a trigger are kept as one packed entry. An item is answered once the watermark has passed the end of the bucket, or of its
    longest window if that comes first; past the end of the bucket nothing is kept. Only parts that hold comments are given out, and the last
    part of an item, so that items without comments appear.
    """

    def __init__(self, widths: tuple[int, ...], span: int):
        self.widths, self.span = widths, span * MICRO

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.comments = handle.getListState("comments", "rows binary")
        self.items = handle.getListState("items", "rows binary")
        self.timer = handle.getValueState("timer", "at bigint")

    def _due(self, bucket: int, items: pd.DataFrame) -> np.ndarray:
        """Watermark in milliseconds from which an item can be answered here."""
        final = items["us"].to_numpy() + max(self.widths) * HOUR * MICRO
        return np.minimum(final // 1000 + 1, (bucket + 1) * self.span // 1000)

    def _wake(self, at: int) -> None:
        """One timer a key, at the earliest time that matters; it fires when the watermark is later than it."""
        if self.timer.exists():
            held = int(self.timer.get()[0])
            if held <= at:
                return
            self.handle.deleteTimer(held)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        wake = (int(key[1]) + 1) * self.span // 1000 - 1
        for part in rows:
            is_item = part["is_item"].to_numpy(dtype=bool)
            if is_item.any():
                items = part.loc[is_item, ["gid", "us"]]
                self.items.appendValue((_packed(items),))
                wake = min(wake, int(self._due(int(key[1]), items).min()) - 1)
            if not is_item.all():
                self.comments.appendValue((_packed(part.loc[~is_item, ["us", "score"]]),))
        self._wake(wake)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, bucket = int(timerValues.getCurrentWatermarkInMs()), int(key[1])
        self.timer.clear()
        items = _unpacked(self.items.get())
        ready = None if items is None else self._due(bucket, items) <= now
        if ready is not None and ready.any():
            yield self._answers(key[0], bucket, items[ready], _unpacked(self.comments.get()))
        end = (bucket + 1) * self.span // 1000
        if now >= end:
            self.items.clear()
            self.comments.clear()
            return
        wake, left = end - 1, None if items is None else items[~ready]
        self.items.clear()
        if left is not None and len(left):
            self.items.appendValue((_packed(left),))
            wake = min(wake, int(self._due(bucket, left).min()) - 1)
        self._wake(max(wake, int(expiredTimerInfo.getExpiryTimeInMs()) + 1))

    def _answers(self, app: str, bucket: int, items: pd.DataFrame, comments: pd.DataFrame | None) -> pd.DataFrame:
        if comments is None:
            comments = pd.DataFrame({"us": np.array([], "int64"), "score": np.array([], "float64")})
        comments = comments.sort_values("us", kind="stable")
        at, score = comments["us"].to_numpy(), comments["score"].to_numpy(dtype="float64")
        known = ~np.isnan(score)
        value = np.where(known, score, 0.0)
        upto = lambda x, kind: np.concatenate([[kind(0)], np.cumsum(x, dtype=kind)])
        sums = {
            "scored": upto(known, np.int64), "total": upto(value, np.longdouble),
            "negative": upto(known & (value <= -0.05), np.int64), "positive": upto(known & (value >= 0.05), np.int64),
        }
        us = items["us"].to_numpy()
        final = us + max(self.widths) * HOUR * MICRO
        first = np.searchsorted(at, us, "left")
        out = {"appid": app, "gid": items["gid"].to_numpy(), "published_us": us}
        for w in self.widths:
            last = np.maximum(np.searchsorted(at, us + w * HOUR * MICRO, "right"), first)
            out[f"n_{w}"] = last - first
            for name, running in sums.items():
                out[f"{name}_{w}"] = (running[last] - running[first]).astype("float64" if name == "total" else "int64")
        # Later than the watermark that made the item final, to the millisecond in which watermarks count.
        out["final_at"] = pd.to_datetime((final // 1000 + 1) * 1000, unit="us", utc=True)
        parts = pd.DataFrame(out)
        return parts[(parts[f"n_{max(self.widths)}"] > 0) | (final // self.span == bucket)]

    def close(self) -> None:
        pass


def news_windows_stream(news: DataFrame, comments: DataFrame, score: str = "score", widths: tuple[int, ...] = config.ROLLING_HOURS,
                        delay: str = "1 hour", bucket_hours: int = BUCKET_HOURS) -> DataFrame:
    """Comment count, mean score and negative/positive shares in the first w hours after every item, once its longest window is over.

    ``news``: appid, gid, published_at; ``comments``: appid, ts, score; both streams. An item without comments has a count of 0 and no means.
    Both sides carry a watermark: comments that cannot meet an item any more, and items whose windows are over, leave the state. Rows later
    than the delay are dropped, as are rows without an app or a time; a score that is no number counts as unknown.

    An item is dealt to the buckets of hours that its windows touch and a comment belongs to one, so the state of an app is
    spread by (app, bucket). In a bucket items look their windows up in running sums, so items and comments are never paired; the
    parts of an item are added up afterwards.
    """
    ship_package(with_state_store(news.sparkSession))
    longest, span = max(widths), bucket_hours * HOUR
    items = news.where("appid IS NOT NULL AND published_at IS NOT NULL").select("appid", "gid", "published_at").withWatermark("published_at", delay)
    first, last = [F.floor((F.unix_seconds("published_at") + h * HOUR) / span) for h in (0, longest)]
    items = items.select(
        "appid", F.explode(F.sequence(first, last)).alias("bucket"), F.col("published_at").alias("at"), F.lit(True).alias("is_item"),
        F.col("gid").cast("string").alias("gid"), F.unix_micros("published_at").alias("us"), F.lit(None).cast("double").alias("score"))
    rows = comments.where("appid IS NOT NULL AND ts IS NOT NULL").select("appid", "ts", F.col(score).cast("double").alias("score")).withWatermark("ts", delay)
    rows = rows.select(
        "appid", F.floor(F.unix_seconds("ts") / span).alias("bucket"), F.col("ts").alias("at"), F.lit(False).alias("is_item"),
        F.lit(None).cast("string").alias("gid"), F.unix_micros("ts").alias("us"), "score")
    kinds = {p: "double" if p == "total" else "bigint" for p in PARTS}
    parts = items.unionByName(rows).groupBy("appid", "bucket").transformWithStateInPandas(
        statefulProcessor=WindowParts(tuple(widths), span),
        outputStructType=", ".join(["appid string, gid string, published_us bigint", *[f"{p}_{w} {t}" for w in widths for p, t in kinds.items()], "final_at timestamp"]),
        outputMode="Append", timeMode="EventTime", eventTimeColumnName="final_at")
    sums = parts.groupBy("appid", "gid", "published_us", "final_at").agg(*[F.sum(f"{p}_{w}").alias(f"{p}_{w}") for w in widths for p in PARTS])
    out = []
    for w in widths:
        per = lambda p: F.col(f"{p}_{w}") / F.nullif(F.col(f"scored_{w}"), F.lit(0))
        out += [F.col(f"n_{w}").alias(f"count_in_{w}h"), per("total").alias(f"avg_sent_in_{w}h"),
                per("negative").alias(f"neg_ratio_in_{w}h"), per("positive").alias(f"pos_ratio_in_{w}h")]
    return sums.select("appid", "gid", F.timestamp_micros("published_us").alias("published_at"), *out)
