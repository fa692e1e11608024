"""Reviews against update windows, range scans and top-n per app."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..session import broadcast_if_small
from .positions import running_position

DAY_MICROS = 86_400_000_000


def scan_range(reviews: DataFrame, appid: str, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Reviews of one app in [start, end], both inclusive, newest first.

    On a table partitioned by appid this prunes partitions and pushes the time range into the Parquet scan.
    """
    hit = (F.col("appid") == appid) & F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return reviews.where(hit).orderBy(F.desc(ts), "review_id")


def with_bounds(updates: DataFrame) -> DataFrame:
    """Add window_start and window_end to update rows (update_ts, pre_days, post_days)."""
    at = F.date_trunc("second", "update_ts")
    return updates.withColumns({
        "update_ts": at,
        "window_start": at - F.make_dt_interval(F.col("pre_days")),
        "window_end": at + F.make_dt_interval(F.col("post_days")),
    })


def window_tag(ts: Column, update_ts: Column) -> Column:
    return F.when(ts < update_ts, "pre").otherwise("post")


def split_windows(reviews: DataFrame, updates: DataFrame, ts: str = "ts", carry: tuple[str, ...] = ()) -> DataFrame:
    """Reviews inside any update window of their app, tagged 'pre' [U-pre, U) or 'post' [U, U+post].

    Times are compared at second resolution. Each update is spread over the days its window covers and joined on
    (appid, day): a hot app is split by day, and no review meets an update it cannot belong to. ``carry`` names
    further update columns to keep.
    """
    days = with_bounds(updates).select(
        "appid", "update_id", "update_ts", "window_start", "window_end", *carry,
        F.explode(F.sequence(F.to_date("window_start"), F.to_date("window_end"))).alias("_day"),
    )
    left = reviews.withColumns({ts: F.date_trunc("second", ts), "_day": F.to_date(ts)})
    inside = left.join(broadcast_if_small(days), ["appid", "_day"]).where(
        F.col(ts).between(F.col("window_start"), F.col("window_end"))
    )
    return inside.withColumn("window", window_tag(F.col(ts), F.col("update_ts"))).drop(
        "_day", "window_start", "window_end"
    )


def latest_per_app(reviews: DataFrame, n: int, ts: str = "ts") -> DataFrame:
    """The newest ``n`` reviews of every app. Spark cuts each partition to n rows per app before the shuffle."""
    w = Window.partitionBy("appid").orderBy(F.desc(ts), "review_id")
    return reviews.withColumn("recency_rank", F.row_number().over(w)).where(F.col("recency_rank") <= n)


def patch_notes(news: DataFrame, since: Column | None = None) -> DataFrame:
    """News items tagged as patch notes or with an update word in the title (split on white space only)."""
    title_words = F.split(F.lower(F.coalesce("title", F.lit(""))), r"(?U)\s+")
    by_title = F.arrays_overlap(title_words, F.array(*[F.lit(w) for w in config.UPDATE_TITLE_WORDS]))
    hit = by_title
    if "tags" in news.columns:
        tags = F.transform(F.col("tags"), F.lower)
        by_tag = F.arrays_overlap(tags, F.array(*[F.lit(t) for t in config.UPDATE_TAGS]))
        hit = by_title | F.coalesce(by_tag, F.lit(False))
    if since is not None:
        hit = hit & (F.col("published_at") >= since)
    return news.where(hit)


def gray_zone(df: DataFrame, cut: float = config.LABEL_CUT) -> DataFrame:
    """Rows whose compound is ambiguous, the cuts included."""
    return df.where(F.col("compound").between(-cut, cut))


def gray_queue(df: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """The ambiguous rows of every group in order of age; with ``rows`` only the first of each group.

    Rows are numbered by (group, day) and shifted by the counts of earlier days, so a hot group is split by day.
    """
    placed = running_position(gray_zone(df), keys, F.to_date("ts"), ["ts", "review_id"], "queue_pos")
    return placed if rows is None else placed.where(F.col("queue_pos") <= rows)


def disagrees(compound: str = "compound", vote: str = "voted_up", cut: float = config.DISAGREE_CUT) -> Column:
    """Positive text with a thumbs-down, or negative text with a thumbs-up."""
    c, v = F.col(compound), F.col(vote)
    return F.coalesce(((c > cut) & ~v) | ((c < -cut) & v), F.lit(False))


def disagreement_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.count_if(disagrees()).alias("n_disagreements")
    ).withColumn("disagreement_pct", F.bround(F.col("n_disagreements") / F.greatest("n_rows", F.lit(1)), 4))


def top_rows(df: DataFrame, k: int, by: str = "risk_score", tie: str = "review_id") -> DataFrame:
    """The k highest rows overall (each task keeps k rows, the merge sees k per task)."""
    return df.orderBy(F.desc(by), tie).limit(k)


def top_per_group(df: DataFrame, keys: list[str], k: int, by: list[Column], rank: str = "rank") -> DataFrame:
    """The first k rows of every group under ``by``; cut to k per partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
