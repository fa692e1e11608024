"""Registered queries: every streaming job over the supplied tables, against its batch meaning in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sentiment import label
from ..operators.quantiles import exact_quantiles
from ..session import fresh_path, save_table
from ..operators import windows
from ..streaming import jobs, news, trends
from . import sql as S
from . import views as V
from .registry import iso, query, r6
from .trend_queries import NEWS_WINDOWS, WIDTHS


BATCHES, FILES = 4, 4


def _landed(df: DataFrame, name: str, late: DataFrame | None = None, files: int = FILES) -> DataFrame:
    """The rows as a stream, a quarter of the time (of ``files`` files) a trigger; ``late`` rows arrive in a last trigger of their own."""
    df = save_table(df, f"{name}-rows")
    path = fresh_path(df.sparkSession, name)
    cuts = exact_quantiles(df.withColumn("_us", F.unix_micros("ts")), "_us", tuple(i / BATCHES for i in range(1, BATCHES)))
    bounds = list(cuts.first())  # one row
    at = F.unix_micros("ts")
    for i in range(BATCHES):  # files of a stream are taken in the order in which they were written
        part = df
        part = part.where(at > bounds[i - 1]) if i else part
        part = part.where(at <= bounds[i]) if i < BATCHES - 1 else part
        part.repartition(files).write.mode("append").parquet(path)
    if late is not None:
        late.select(*df.columns).repartition(files).write.mode("append").parquet(path)
    return jobs.read_stream(df.sparkSession, path, df.schema, files_per_batch=files)


def _late(events: DataFrame) -> DataFrame:
    """The earliest row of each app once more: far behind the watermark when it comes, so it counts for nothing."""
    first = events.groupBy("appid").agg(F.min("ts").alias("ts"))
    return events.join(first, ["appid", "ts"])


@query("T-1", S.with_blocks(
    "SELECT review_id, risk_score, risk_level FROM levelled WHERE risk_level IN ('Critical', 'High')", "levelled"))
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    cores = spark.sparkContext.defaultParallelism  # texts are scored file by file
    rows = _landed(V.reviews(spark, sf_dir), "reviews", files=max(FILES, cores))
    out = jobs.run_to_parquet(jobs.score_stream(rows), "scored")
    return out.select("review_id", "risk_score", "risk_level")


@query("T-2", S.with_blocks("SELECT appid, count(*) AS n_reviews FROM reviews_v GROUP BY appid", "reviews_v"))
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.reviews(spark, sf_dir).select("appid", "review_id", "ts")
    stream = jobs.dedup_stream(_landed(rows.unionByName(rows), "repeated", rows), "60 days")
    return jobs.run_to_parquet(stream, "distinct").groupBy("appid").agg(F.count("*").alias("n_reviews"))


@query("T-2, S6", S.with_blocks("SELECT appid, count(*) AS n_reviews FROM reviews_v GROUP BY appid", "reviews_v"))
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.reviews(spark, sf_dir).select("appid", "review_id", "review_content", "ts")
    store = fresh_path(spark, "store")
    for name in ("first", "second"):  # the second run finds everything stored
        jobs.ingest_stream(_landed(rows, name), store, fresh_path(spark, f"{name}-state")).awaitTermination()
    return spark.read.parquet(store).groupBy(F.col("appid").cast("string").alias("appid")).agg(
        F.count("*").alias("n_reviews"))


# An hour is final once the watermark (latest time minus one hour) has passed its end.
_FINAL = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query("T-3, G13", S.with_blocks(f"""
SELECT appid, {S.iso('h')} AS hour, n_reviews, n_positive, n_neutral, n_negative, {S.s6('s')} AS sum_score FROM (
  SELECT appid, date_trunc('hour', ts) AS h, count(*) AS n_reviews, count(*) FILTER (score >= 0.2) AS n_positive,
         count(*) FILTER (score > -0.2 AND score < 0.2) AS n_neutral, count(*) FILTER (score <= -0.2) AS n_negative,
         sum(score) AS s FROM events_v GROUP BY ALL) WHERE h + INTERVAL 1 HOUR <= {_FINAL}""", "events_v"))
def stream_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.scored_events(spark, sf_dir)
    ev = _landed(rows, "events", _late(rows)).withColumn("sentiment_label", label("score"))
    out = jobs.run_to_parquet(jobs.hourly_labels(ev), "hourly")
    return out.withColumns({"hour": iso("hour"), "sum_score": r6("sum_score")})


@query("T-3, W3", S.with_blocks(f"""
SELECT appid, {S.iso('e')} AS window_end, count(*) AS n_rows FROM (
  SELECT appid, unnest(generate_series(date_trunc('hour', ts) + INTERVAL 1 HOUR, date_trunc('hour', ts) + INTERVAL 24 HOUR,
         INTERVAL 1 HOUR)) AS e FROM events_v) WHERE e <= {_FINAL} GROUP BY ALL""", "events_v"))
def stream_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.scored_events(spark, sf_dir).select("appid", "ts")
    ev = _landed(rows, "events", _late(rows))
    out = jobs.run_to_parquet(jobs.sliding_rate(ev), "rate")
    return out.withColumn("window_end", iso("window_end"))


@query("T-4", S.with_blocks(f"""
SELECT h.appid, {S.iso('h')} AS hour, n_rows FROM (
  SELECT appid, date_trunc('hour', ts) AS h, count(*) AS n_rows FROM events_v GROUP BY ALL) h
JOIN (SELECT appid, count(*) / 720.0::DOUBLE AS b FROM events_v GROUP BY appid) b ON b.appid = h.appid
WHERE n_rows > 3 * b AND h + INTERVAL 1 HOUR <= {_FINAL}""", "events_v"))
def stream_volume_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.scored_events(spark, sf_dir).select("appid", "ts")
    baseline = rows.groupBy("appid").agg((F.count("*") / 720.0).alias("baseline_per_hour"))
    out = jobs.run_to_parquet(jobs.volume_alerts(_landed(rows, "events", _late(rows)), baseline), "volume")
    return out.select("appid", iso("hour").alias("hour"), "n_rows")


@query("T-3, T-4, W1, W3, G14", S.with_blocks(f"""
SELECT * FROM (WITH h AS (
  SELECT appid, date_trunc('hour', ts) AS hour, count(*) AS n, sum(score) AS total, count(*) FILTER (score < 0) AS negative
  FROM events_v GROUP BY ALL),
k AS (SELECT *, CAST(epoch(hour) AS BIGINT) // 3600 AS at, CAST(epoch(hour) - epoch(min(hour) OVER (PARTITION BY appid)) AS BIGINT) // 604800 AS weeks FROM h),
rolled AS (
  SELECT a.appid, a.at, CAST(sum(b.n) AS BIGINT) AS n, sum(b.total) / sum(b.n) AS mean, sum(b.negative) / sum(b.n) AS negative
  FROM k a JOIN k b ON b.appid = a.appid AND b.at BETWEEN a.at - 23 AND a.at GROUP BY ALL),
past AS (
  SELECT a.appid, a.at, sum(b.n * pow(0.5::DOUBLE, (a.at - b.at) // 168)) AS s
  FROM k a JOIN k b ON b.appid = a.appid AND b.at < a.at AND b.at % 168 = a.at % 168 GROUP BY ALL),
judged AS (
  SELECT k.*, r.n AS rn, r.mean, r.negative AS rneg,
         CASE WHEN weeks > 0 THEN coalesce(s, 0) / (1 - pow(0.5::DOUBLE, weeks)) END AS b
  FROM k JOIN rolled r ON r.appid = k.appid AND r.at = k.at LEFT JOIN past p ON p.appid = k.appid AND p.at = k.at)
SELECT appid, {S.iso('hour')} AS hour, n AS n_rows, rn AS n_rolling, {S.s6('mean')} AS mean_rolling, {S.s6('rneg')} AS negative_rolling,
       {S.s6('b')} AS baseline, coalesce(n > 3 * b, false) AS is_volume_alert
FROM judged WHERE hour + INTERVAL 1 HOUR <= {_FINAL})""", "events_v"))
def stream_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.scored_events(spark, sf_dir).select("appid", "ts", "score")
    out = jobs.run_to_parquet(trends.hourly_trends(_landed(rows, "events", _late(rows))), "trends")
    return out.withColumns({"hour": iso("hour"), **{c: r6(c) for c in ("mean_rolling", "negative_rolling", "baseline")}})


# An item is final once both watermarks have passed its longest window.
@query("J6, T-3", S.with_blocks(f"""
SELECT n.appid, n.gid, {', '.join(NEWS_WINDOWS)} FROM notes_v n
LEFT JOIN events_v e ON e.appid = n.appid AND e.ts >= n.published_at AND e.ts <= n.published_at + INTERVAL 72 HOUR
WHERE n.published_at + INTERVAL 72 HOUR < least((SELECT max(ts) FROM events_v), (SELECT max(published_at) FROM notes_v)) - INTERVAL 1 HOUR
GROUP BY n.appid, n.gid""", "events_v", "notes_v"))
def stream_news_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = windows.patch_notes(V.news(spark, sf_dir)).select("appid", "gid", F.col("published_at").alias("ts"))
    items = _landed(notes, "notes").withColumnRenamed("ts", "published_at")
    rows = _landed(V.scored_events(spark, sf_dir).select("appid", "ts", "score"), "events")
    out = jobs.run_to_parquet(news.news_windows_stream(items, rows), "news-windows")
    ratios = [f"{p}_in_{w}h" for w in WIDTHS for p in ("avg_sent", "neg_ratio", "pos_ratio")]
    return out.withColumns({c: r6(c) for c in ratios}).drop("published_at")
