"""Joins between updates, announcements, comments and dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions import text
from ..session import broadcast_if_small
from .positions import running_position
from .windows import with_bounds

KEYS = ["appid", "update_id"]


def usable_topics(comments: DataFrame) -> DataFrame:
    """(appid, forum_topic_id) with at least one comment that is not blank."""
    return comments.where(~text.is_blank("content")).select("appid", "forum_topic_id").distinct()


def _neighbours(updates: DataFrame, events: DataFrame) -> DataFrame:
    """For every update the events (appid, event_ts, gid) at the last time up to it and at the first one after it.

    The distinct times of an app are numbered in order and updates are placed in the same numbering, so no update meets all
    events of its app. Of several events at one time the least gid stands for all.
    """
    dated = events.where("event_ts IS NOT NULL").groupBy("appid", F.col("event_ts").alias("_t")).agg(F.min("gid").alias("gid"))
    both = dated.select("appid", "_t").unionByName(
        updates.select("appid", "update_id", F.col("update_ts").alias("_t")), allowMissingColumns=True
    )
    is_time = F.col("update_id").isNull().cast("int")
    tagged = both.withColumn("_day", F.floor(F.unix_seconds("_t") / 86400))
    per_day = tagged.groupBy("appid", "_day").agg(F.sum(is_time).alias("_n"))
    shift = F.coalesce(
        F.sum("_n").over(Window.partitionBy("appid").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    per_day = per_day.select("appid", "_day", shift.alias("_shift"))
    # A time equal to the update's comes first, so it counts as "before".
    inner = Window.partitionBy("appid", "_day").orderBy("_t", is_time.desc()).rowsBetween(Window.unboundedPreceding, 0)
    placed = tagged.withColumn("_in", F.sum(is_time).over(inner)).join(per_day, ["appid", "_day"]).withColumn(
        "_pos", F.col("_in") + F.col("_shift")
    )
    times = placed.where("update_id IS NULL").select("appid", "_pos", F.col("_t").alias("event_ts"))
    up = placed.where("update_id IS NOT NULL").select(
        "appid", "update_id", F.col("_t").alias("_update_ts"), F.explode(F.array("_pos", F.col("_pos") + 1)).alias("_pos")
    )
    return up.join(times, ["appid", "_pos"]).join(dated.withColumnRenamed("_t", "event_ts"), ["appid", "event_ts"])


def nearest_with_comments(updates: DataFrame, events: DataFrame, topics: DataFrame, since_start: bool = False) -> DataFrame:
    """The event (appid, gid, forum_topic_id, event_name, event_ts) closest in time to each update among all with usable comments.

    Events without a time come after all others, by gid. With ``since_start`` only events from the start of the update's
    window on count, and undated ones do not.
    """
    usable = events.where("forum_topic_id <> ''").join(topics, ["appid", "forum_topic_id"], "left_semi")
    near = _neighbours(updates, usable)
    if since_start:
        start = with_bounds(updates).select(*KEYS, "window_start")
        near = near.join(start, KEYS).where(F.col("event_ts") >= F.col("window_start"))
    found = near.select(*KEYS, "gid", F.abs(F.unix_seconds("event_ts") - F.unix_seconds("_update_ts")).alias("gap_seconds"))
    if not since_start:
        undated = usable.where("event_ts IS NULL").groupBy("appid").agg(F.min("gid").alias("gid"))
        found = found.unionByName(updates.select(*KEYS).join(undated, "appid").withColumn("gap_seconds", F.lit(None).cast("bigint")))
    best = found.groupBy(*KEYS).agg(F.min(F.struct(F.col("gap_seconds").isNull(), "gap_seconds", "gid")).alias("_b"))
    info = usable.select("appid", "gid", "forum_topic_id", "event_name")
    return best.select(*KEYS, "_b.gid", "_b.gap_seconds").join(info, ["appid", "gid"])


def nearest_comment_source(updates: DataFrame, events: DataFrame, notes: DataFrame, comments: DataFrame) -> DataFrame:
    """Where each update's comments come from: its nearest announcement, else its nearest patch note since the start of
    its window, else nothing."""
    topics = usable_topics(comments)
    by_event = nearest_with_comments(updates, events, topics)
    note_events = notes.select(
        "appid", "gid", F.col("gid").alias("forum_topic_id"), F.col("title").alias("event_name"),
        F.col("published_at").alias("event_ts"),
    )
    by_note = nearest_with_comments(updates, note_events, topics, since_start=True)
    e = by_event.select(*KEYS, F.struct("gid", "forum_topic_id", "event_name", "gap_seconds").alias("_e"))
    n = by_note.select(*KEYS, F.struct("gid", "forum_topic_id", "event_name", "gap_seconds").alias("_n"))
    out = updates.select(*KEYS).join(e, KEYS, "left").join(n, KEYS, "left")
    source = F.when(F.col("_e").isNotNull(), "announcement").when(F.col("_n").isNotNull(), "patch_note")
    return out.select(*KEYS, source.alias("comment_source"), F.coalesce("_e", "_n").alias("c")).select(
        *KEYS, "comment_source", "c.*"
    )


def comments_of_updates(comments: DataFrame, sources: DataFrame) -> DataFrame:
    """The comments under each update's chosen topic (``sources``: appid, update_id, forum_topic_id)."""
    chosen = sources.where("forum_topic_id IS NOT NULL").select(*KEYS, "forum_topic_id")
    return comments.join(chosen, ["appid", "forum_topic_id"])


def first_source(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the first source (in list order) that has any row for a key."""
    tagged = None
    for i, s in enumerate(sources):
        part = s.withColumn("source_priority", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    best = tagged.groupBy(*keys).agg(F.min("source_priority").alias("source_priority"))
    return tagged.join(best, [*keys, "source_priority"])


def override_labels(rows: DataFrame, new_labels: DataFrame, ids: list[str],
                    label: str = "sentiment_label") -> DataFrame:
    """New labels replace old ones for the rows (``ids``) that have one."""
    side = new_labels.select(*ids, F.col(label).alias("_new"))
    return rows.join(side, ids, "left").withColumn(label, F.coalesce("_new", label)).drop("_new")


def attach_app_info(df: DataFrame, apps: DataFrame) -> DataFrame:
    """app_name and developer with the usual defaults for unknown apps."""
    side = apps.select("appid", F.col("name").alias("_name"), F.col("developer").alias("_dev"))
    return df.join(broadcast_if_small(side), "appid", "left").withColumns({
        "app_name": F.coalesce("_name", F.concat(F.lit("App "), F.col("appid"))),
        "developer": F.coalesce("_dev", F.lit("Unknown")),
    }).drop("_name", "_dev")


def window_aggregates(hours: Column, score: Column, widths: tuple[int, ...]) -> list[Column]:
    out = []
    for w in widths:
        inside = hours <= w
        out += [
            F.count_if(inside).alias(f"count_in_{w}h"),
            F.avg(F.when(inside, score)).alias(f"avg_sentiment_in_{w}h"),
            F.avg(F.when(inside, (score <= -config.RATIO_CUT).cast("double"))).alias(f"neg_ratio_in_{w}h"),
            F.avg(F.when(inside, (score >= config.RATIO_CUT).cast("double"))).alias(f"pos_ratio_in_{w}h"),
        ]
    return out


def attach_window_features(aligned: DataFrame, keys: list[str], score: str,
                           widths: tuple[int, ...] = config.ROLLING_HOURS) -> DataFrame:
    """Per-group statistics of the rows within w hours of their latest news item, on every row of the group."""
    stats = aligned.groupBy(*keys).agg(*window_aggregates(F.col("hours_since_latest_news"), F.col(score), widths))
    return aligned.join(stats, keys, "left")


__all__ = [
    "attach_app_info", "attach_window_features", "comments_of_updates", "first_source", "nearest_comment_source", "nearest_with_comments",
    "override_labels", "running_position", "usable_topics",
]
