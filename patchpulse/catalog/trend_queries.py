"""Registered queries: rolling features, as-of alignment, news windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import timeline, windows
from . import sql as S
from . import views as V
from .registry import iso, query, r6

WIDTHS = (24, 48, 72)
EVENT_OUT = ("appid", "event_id")


def _frames() -> str:
    return "WINDOW " + ", ".join(
        f"w{w} AS (PARTITION BY appid ORDER BY epoch_us(ts) RANGE BETWEEN {w * 3600000000 - 1} PRECEDING AND CURRENT ROW)"
        for w in WIDTHS
    )


_cols = []
for _w in WIDTHS:
    _cols += [
        f"avg(score) OVER w{_w} AS sentiment_rolling_mean_{_w}h",
        f"stddev_samp(score) OVER w{_w} AS sentiment_rolling_std_{_w}h",
        f"min(score) OVER w{_w} AS sentiment_rolling_min_{_w}h",
        f"max(score) OVER w{_w} AS sentiment_rolling_max_{_w}h",
        f"avg(CASE WHEN score < -0.05 THEN 1.0::DOUBLE ELSE 0 END) OVER w{_w} AS neg_ratio_rolling_{_w}h",
        f"avg(CASE WHEN score > 0.05 THEN 1.0::DOUBLE ELSE 0 END) OVER w{_w} AS pos_ratio_rolling_{_w}h",
        f"count(*) OVER w{_w} AS comment_rate_{_w}h",
    ]
S.block("rolled", f"SELECT appid, event_id, ts, score, {', '.join(_cols)} FROM events_v {_frames()}", "events_v")
_diff = []
for _w in WIDTHS:
    _m, _r = f"sentiment_rolling_mean_{_w}h", f"comment_rate_{_w}h"
    _diff += [
        f"{_m} - lag({_m}) OVER o AS sentiment_diff_{_w}h",
        f"({_m} - lag({_m}) OVER o) - (lag({_m}) OVER o - lag({_m}, 2) OVER o) AS sentiment_acceleration_{_w}h",
        f"({_r} - lag({_r}) OVER o) / nullif(lag({_r}) OVER o, 0) AS comment_rate_change_{_w}h",
    ]
S.block("trends", f"""
SELECT *, {', '.join(_diff)},
       coalesce(CAST(sentiment_rolling_mean_24h > lag(sentiment_rolling_mean_24h) OVER o + 1e-9
         AND sentiment_rolling_mean_24h > lead(sentiment_rolling_mean_24h) OVER o + 1e-9 AS INT), 0) AS is_sentiment_local_peak,
       coalesce(CAST(sentiment_rolling_mean_24h < lag(sentiment_rolling_mean_24h) OVER o - 1e-9
         AND sentiment_rolling_mean_24h < lead(sentiment_rolling_mean_24h) OVER o - 1e-9 AS INT), 0) AS is_sentiment_local_trough,
       CASE WHEN abs(sentiment_rolling_mean_72h - lag(sentiment_rolling_mean_72h) OVER o) <= 1e-9 THEN 0
            ELSE CAST(sign(sentiment_rolling_mean_72h - lag(sentiment_rolling_mean_72h) OVER o) AS INT) END
         AS sentiment_trend_direction,
       sentiment_rolling_std_72h / (abs(sentiment_rolling_mean_72h) + 0.01) AS sentiment_volatility
FROM rolled WINDOW o AS (PARTITION BY appid ORDER BY ts, event_id)""", "rolled")

ROLL_FLOATS = [
    f"{p}_{w}h" for w in WIDTHS
    for p in ("sentiment_rolling_mean", "sentiment_rolling_std", "sentiment_rolling_min", "sentiment_rolling_max",
              "neg_ratio_rolling", "pos_ratio_rolling")
]
TREND_FLOATS = [f"{p}_{w}h" for w in WIDTHS for p in ("sentiment_diff", "sentiment_acceleration", "comment_rate_change")]


@query("W1-W3", S.with_blocks(
    f"SELECT appid, event_id, {', '.join(f'{S.s6(c)} AS {c}' for c in ROLL_FLOATS)}, "
    f"{', '.join(f'comment_rate_{w}h' for w in WIDTHS)} FROM rolled", "rolled"))
def rolling_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = timeline.rolling_features(V.scored_events(spark, sf_dir))
    return rolled.select(*EVENT_OUT, *[r6(c).alias(c) for c in ROLL_FLOATS], *[f"comment_rate_{w}h" for w in WIDTHS])


@query("W5-W9", S.with_blocks(
    f"SELECT appid, event_id, {', '.join(f'{S.s6(c)} AS {c}' for c in [*TREND_FLOATS, 'sentiment_volatility'])}, "
    "is_sentiment_local_peak, is_sentiment_local_trough, sentiment_trend_direction FROM trends", "trends"))
def trend_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeline.trend_features(timeline.rolling_features(V.scored_events(spark, sf_dir)))
    return out.select(
        *EVENT_OUT, *[r6(c).alias(c) for c in [*TREND_FLOATS, "sentiment_volatility"]],
        "is_sentiment_local_peak", "is_sentiment_local_trough", "sentiment_trend_direction",
    )


_e = ", ".join(
    f"{S.s6(f'avg(x) OVER w{w}')} AS engagement_rolling_{w}h" for w in WIDTHS
)


@query("W4", S.with_blocks(
    f"SELECT appid, event_id, {_e} FROM (SELECT *, ln(1 + value) AS x FROM events_v) {_frames()}", "events_v"))
def rolling_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = V.scored_events(spark, sf_dir).withColumn("engagement", F.log1p("value"))
    out = timeline.rolling_mean(ev, "engagement", "engagement")
    return out.select(*EVENT_OUT, *[r6(f"engagement_rolling_{w}h").alias(f"engagement_rolling_{w}h") for w in WIDTHS])


@query("W10, X15", S.with_blocks(f"""
SELECT appid, event_id, count(*) OVER (PARTITION BY appid, date_trunc('hour', ts)) AS hourly_count,
       CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS day_of_week, CAST(isodow(ts) >= 6 AS INT) AS is_weekend
FROM events_v""", "events_v"))
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeline.add_hourly_count(V.scored_events(spark, sf_dir)).withColumns(text.calendar("ts"))
    return out.select(*EVENT_OUT, "hourly_count", "hour", "day_of_week", "is_weekend")


@query("W12", S.with_blocks(f"""
SELECT appid, event_id, {S.iso('''last_value(t IGNORE NULLS) OVER (PARTITION BY appid ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)''')} AS ts
FROM (SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS t FROM events_v)""", "events_v"))
def filled_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = V.scored_events(spark, sf_dir).withColumn("ts", F.expr("CASE WHEN event_type <> 'error' THEN ts END"))
    return timeline.fill_missing_times(ev).select(*EVENT_OUT, iso("ts").alias("ts"))


@query("J5", S.with_blocks(f"""
SELECT e.appid, e.event_id, {S.iso('n.published_at')} AS latest_news_date,
       {S.s6('(epoch_us(e.ts) - epoch_us(n.published_at)) / 3600000000.0::DOUBLE')} AS hours_since_latest_news
FROM events_v e ASOF LEFT JOIN (SELECT DISTINCT appid, published_at FROM notes_v) n
  ON e.appid = n.appid AND e.ts >= n.published_at""", "events_v", "notes_v"))
def latest_patch_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = windows.patch_notes(V.news(spark, sf_dir))
    out = timeline.align_to_latest_patch(V.scored_events(spark, sf_dir), notes)
    return out.select(*EVENT_OUT, iso("latest_news_date").alias("latest_news_date"),
                      r6("hours_since_latest_news").alias("hours_since_latest_news"))


NEWS_WINDOWS = []
for _w in WIDTHS:
    _in = f"e.ts <= n.published_at + INTERVAL {_w} HOUR"
    NEWS_WINDOWS += [
        f"count(*) FILTER ({_in}) AS count_in_{_w}h",
        f"{S.s6(f'avg(score) FILTER ({_in})')} AS avg_sent_in_{_w}h",
        f"{S.s6(f'avg(CASE WHEN score <= -0.05 THEN 1.0::DOUBLE ELSE 0 END) FILTER ({_in})')} AS neg_ratio_in_{_w}h",
        f"{S.s6(f'avg(CASE WHEN score >= 0.05 THEN 1.0::DOUBLE ELSE 0 END) FILTER ({_in})')} AS pos_ratio_in_{_w}h",
    ]


@query("J6", S.with_blocks(f"""
SELECT n.appid, n.gid, {', '.join(NEWS_WINDOWS)} FROM notes_v n
LEFT JOIN events_v e ON e.appid = n.appid AND e.ts >= n.published_at AND e.ts <= n.published_at + INTERVAL 72 HOUR
GROUP BY n.appid, n.gid""", "events_v", "notes_v"))
def news_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = windows.patch_notes(V.news(spark, sf_dir))
    out = timeline.news_windows(notes, V.scored_events(spark, sf_dir))
    cols = ["appid", "gid"]
    for w in WIDTHS:
        cols.append(f"count_in_{w}h")
        cols += [r6(f"{p}_in_{w}h").alias(f"{p}_in_{w}h") for p in ("avg_sent", "neg_ratio", "pos_ratio")]
    return out.select(*cols)


_tw = []
for _w in WIDTHS:
    _in = f"h <= {_w}"
    _tw += [
        f"count(*) FILTER ({_in}) AS count_in_{_w}h",
        f"{S.s6(f'avg(score) FILTER ({_in})')} AS avg_sentiment_in_{_w}h",
        f"{S.s6(f'avg(CASE WHEN score <= -0.05 THEN 1.0::DOUBLE ELSE 0 END) FILTER ({_in})')} AS neg_ratio_in_{_w}h",
        f"{S.s6(f'avg(CASE WHEN score >= 0.05 THEN 1.0::DOUBLE ELSE 0 END) FILTER ({_in})')} AS pos_ratio_in_{_w}h",
    ]


@query("J7", S.with_blocks(f"""
SELECT x.appid, x.event_id, g.* EXCLUDE (appid) FROM events_v x JOIN (
  SELECT appid, {', '.join(_tw)} FROM (
    SELECT e.appid, e.score, (epoch_us(e.ts) - epoch_us(n.published_at)) / 3600000000.0::DOUBLE AS h
    FROM events_v e ASOF LEFT JOIN (SELECT DISTINCT appid, published_at FROM notes_v) n
      ON e.appid = n.appid AND e.ts >= n.published_at) GROUP BY appid) g ON g.appid = x.appid""",
    "events_v", "notes_v"))
def app_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import joins

    notes = windows.patch_notes(V.news(spark, sf_dir))
    aligned = timeline.align_to_latest_patch(V.scored_events(spark, sf_dir), notes)
    out = joins.attach_window_features(aligned, ["appid"], "score", WIDTHS)
    cols = ["appid", "event_id"]
    for w in WIDTHS:
        cols.append(f"count_in_{w}h")
        cols += [r6(f"{p}_in_{w}h").alias(f"{p}_in_{w}h") for p in ("avg_sentiment", "neg_ratio", "pos_ratio")]
    return out.select(*cols)
