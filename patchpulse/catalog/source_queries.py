"""Registered queries: file imports, payloads, ingest, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..plans import monitor
from ..session import fresh_path
from ..sources import announcements, reviews as rv, sinks
from . import sql as S
from . import views as V
from .registry import iso, query


def _legacy_file(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "legacy")
    V.reviews(spark, sf_dir).selectExpr(
        "concat('u', author_id, '-', doc_id) AS SteamID", "CAST(doc_id % 500 AS STRING) AS played_hours",
        "CASE WHEN doc_id % 4 = 0 THEN '0' ELSE CAST(CAST(playtime_at_review AS INT) AS STRING) END AS playtime_at_review",
        "review_content", "CASE WHEN doc_id % 10 <> 9 THEN CAST(CAST(voted_up AS INT) AS STRING) END AS voted_up",
        "CASE WHEN doc_id % 50 = 7 THEN 'soon' ELSE date_format(ts, 'yyyy-MM-dd') END AS review_date",
        "CAST(votes_up AS STRING) AS votes_up", "'x' AS votes_funny",
        "CASE WHEN num_games_owned < 0 THEN 'Private Account' ELSE CAST(num_games_owned AS STRING) END AS num_games_owned",
        "CAST(substring(appid, 4) AS INT) AS appid",
    ).write.option("header", True).option("escape", '"').csv(path)
    return path


@query("S1-S3, S5, U2", S.with_blocks(f"""
SELECT substring(appid, 4) AS appid, substring(md5(concat('u', author_id, '-', doc_id, '_', strftime(ts, '%Y-%m-%d'))), 1, 16) AS review_id,
       md5(review_content) AS content_md5, CASE WHEN doc_id % 10 <> 9 THEN voted_up ELSE false END AS voted_up,
       strftime(ts, '%Y-%m-%d 00:00:00') AS ts,
       round_even((CASE WHEN doc_id % 4 <> 0 AND trunc(playtime_at_review) > 0 THEN trunc(playtime_at_review) ELSE doc_id % 500 END) / 60, 1)
         AS playtime_hours, votes_up, CAST(0 AS INT) AS votes_funny, num_games_owned, CAST(1 AS INT) AS steam_purchase,
       'english' AS language
FROM reviews_v WHERE doc_id % 50 <> 7 AND review_content IS NOT NULL AND {S.strip('review_content')} <> ''""", "reviews_v"))
def legacy_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rv.import_reviews(rv.read_csv(spark, [_legacy_file(spark, sf_dir)], line_breaks=True))
    return out.select("appid", "review_id", F.md5("review_content").alias("content_md5"), "voted_up", iso("ts").alias("ts"),
                      "playtime_hours", "votes_up", "votes_funny", "num_games_owned", "steam_purchase", "language")


@query("S4, S5", S.with_blocks(f"""
SELECT appid, review_id, voted_up, {S.iso('ts')} AS ts, num_reviews, CAST(-1 AS INT) AS num_games_owned,
       coalesce(nullif(language, 'fr'), 'english') AS language FROM reviews_v WHERE num_reviews <> 3""", "reviews_v"))
def current_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = V.reviews(spark, sf_dir).selectExpr(
        "appid", "review_id", "review_content", "CAST(voted_up AS INT) AS voted_up",
        "CASE WHEN num_reviews <> 3 THEN CAST(ts AS STRING) ELSE 'unknown' END AS timestamp",
        "playtime_at_review / 60 AS playtime_hours", "votes_up", "votes_funny", "num_reviews",
        "nullif(language, 'fr') AS language")
    out = rv.normalise_new(raw, F.col("appid"))
    return out.select("appid", "review_id", "voted_up", iso("ts").alias("ts"), "num_reviews", "num_games_owned", "language")


@query("S6, J9, U3", S.with_blocks(f"""
SELECT appid, count(*) AS n_new FROM reviews_v WHERE NOT (ts < TIMESTAMP '2024-01-06 00:00:00') GROUP BY appid""", "reviews_v"))
def new_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_rows = V.reviews(spark, sf_dir).select("appid", "review_id", "review_content", "ts")
    stored = all_rows.where("ts < TIMESTAMP '2024-01-06 00:00:00'")
    twice = all_rows.unionByName(all_rows)
    fresh = rv.new_rows(twice, stored, ["appid", "review_id"], F.col("ts"))
    return fresh.groupBy("appid").agg(F.count("*").alias("n_new"))


@query("S7", S.with_blocks(f"""
SELECT appid, forum_topic_id, count(*) AS n_comments FROM comments_v WHERE {S.strip('content')} <> '' GROUP BY ALL""", "comments_v"))
def ingested_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "comments")
    batch = V.comments(spark, sf_dir)
    rv.ingest_comments(batch.where("upvotes = 0"), path)
    rv.ingest_comments(batch, path)
    stored = spark.read.parquet(path)
    return stored.groupBy("appid", "forum_topic_id").agg(F.count("*").alias("n_comments"))


@query("S8", S.with_blocks(f"""
SELECT appid, review_id, md5(review_content) AS content_md5, voted_up, {S.iso('ts')} AS ts,
       round_even(CASE WHEN doc_id % 4 = 0 OR playtime_at_review = 0 THEN doc_id % 500 ELSE playtime_at_review END / 60, 1) AS playtime_hours,
       votes_up, CASE WHEN num_games_owned > 0 THEN num_games_owned ELSE -1 END AS num_games_owned, num_reviews,
       CAST(1 AS INT) AS steam_purchase, CAST(0 AS INT) AS received_for_free FROM reviews_v""", "reviews_v"))
def review_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "pages")
    review = F.expr("""named_struct('recommendationid', review_id, 'review', review_content, 'voted_up', voted_up,
        'timestamp_created', unix_seconds(ts), 'votes_up', votes_up, 'author', named_struct(
          'playtime_forever', CAST(doc_id % 500 AS DOUBLE),
          'playtime_at_review', CASE WHEN doc_id % 4 = 0 THEN 0D ELSE playtime_at_review END,
          'num_games_owned', num_games_owned, 'num_reviews', num_reviews))""")
    # A page holds at most 100 reviews of one app.
    pages = V.reviews(spark, sf_dir).groupBy("appid", F.floor(F.col("doc_id") / 100).alias("page")).agg(
        F.collect_list(review).alias("reviews"))
    pages.select("appid", F.lit(1).alias("success"), "reviews").write.json(path)
    out = rv.flatten_payloads(rv.read_payloads(spark, path))
    return out.select("appid", "review_id", F.md5("review_content").alias("content_md5"), "voted_up", iso("ts").alias("ts"),
                      "playtime_hours", "votes_up", "num_games_owned", "num_reviews", "steam_purchase", "received_for_free")


@query("S9, F4", S.with_blocks(f"""
SELECT appid, gid, title, {S.iso('published_at')} AS published_at, length(contents) AS content_length FROM (
  SELECT n.*, e.event_type FROM news_v n JOIN events e ON CAST(e.event_id AS VARCHAR) = n.gid)
WHERE list_has_any(string_split_regex(lower(title), '\\s+'), ['patch', 'update', 'fix', 'hotfix', 'changelog', 'maintenance'])
   OR event_type = 'view'""", "news_v"))
def news_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "news")
    n = V.news(spark, sf_dir)
    tags = F.expr("""CASE WHEN title = 'Community fixes roundup' THEN '[{"tag": "PatchNotes"}]' ELSE '["sale"]' END""")
    item = F.format_string(
        '{"appid": "%s", "appnews": {"newsitems": [{"gid": "%s", "title": "%s", "url": "%s", "date": %d, "contents": %s, '
        '"tags": %s}]}}', "appid", "gid", "title", "url", F.unix_seconds("published_at"),
        F.to_json(F.struct("contents")).substr(F.lit(13), F.length(F.to_json(F.struct("contents"))) - 13), tags)
    n.select(item.alias("value")).write.text(path)
    from ..operators.windows import patch_notes

    out = patch_notes(announcements.flatten_news(announcements.read_news(spark, path)))
    return out.select("appid", "gid", "title", iso("published_at").alias("published_at"),
                      F.length("contents").cast("bigint").alias("content_length"))


@query("S10", """
SELECT page_id, CAST(position - 1 AS INT) AS position, md5(content) AS content_md5 FROM (
  SELECT page_id, unnest(ps) AS content, generate_subscripts(ps, 1) AS position FROM (
    SELECT page_id, regexp_extract_all(html, '<p>([^<]*)</p>', 1) AS ps FROM pages))""")
def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = announcements.text_paragraphs(V.texts(spark, sf_dir, "pages"))
    return out.select("page_id", "position", F.md5("content").alias("content_md5"))


@query("S10", """
SELECT page_id, CAST(0 AS INT) AS position, trim(regexp_extract(html, '<div class="ad">([^<]*)</div>', 1)) AS content FROM pages
WHERE contains(html, '<div class="ad">')""")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = announcements.extract_comments(V.texts(spark, sf_dir, "pages"), block="ad", parts={"content": ("ad",)})
    return out.select("page_id", "position", "content")


@query("S11", S.with_blocks(f"""
SELECT event_id, CASE WHEN event_type <> 'view' THEN strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') END AS published_at
FROM events""", ))
def comment_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("event_type") == "view", F.date_format("ts", "d MMM yyyy '@' HH:mm")).otherwise(
        F.concat(F.date_format("ts", "MMM d, yyyy '@' h:mm"), F.lower(F.date_format("ts", "a"))))
    raw = V.scored_events(spark, sf_dir).select("event_id", shown.alias("raw"))
    return raw.select("event_id", iso(text.parse_comment_time("raw")).alias("published_at"))


@query("S12", S.with_blocks(f"""
SELECT c.appid, comment_id AS review_id, md5({S.strip('content')}) AS content_md5, {S.iso('a.event_ts')} AS ts, upvotes AS votes_up,
       'event_comment' AS source
FROM comments_v c JOIN announcements_v a ON a.appid = c.appid AND a.forum_topic_id = c.forum_topic_id
WHERE {S.strip('content')} <> '' AND a.event_ts IS NOT NULL""", "comments_v", "announcements_v"))
def comments_as_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.announcements(spark, sf_dir).select("appid", "forum_topic_id", "event_ts")
    c = V.comments(spark, sf_dir).join(a, ["appid", "forum_topic_id"]).withColumn(
        "published_at", F.lit(None).cast("timestamp"))
    out = announcements.comments_as_reviews(c, F.col("event_ts"))
    return out.select("appid", "review_id", F.md5("review_content").alias("content_md5"), iso("ts").alias("ts"), "votes_up", "source")


@query("S13, S14", S.with_blocks("""
SELECT language AS genre, count(*) AS n_rows, CAST(sum(votes_up) AS DOUBLE) AS votes_up, 0.0::DOUBLE AS num_reviews
FROM reviews_v GROUP BY language""", "reviews_v"))
def genre_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "genres")
    rows = V.reviews(spark, sf_dir).selectExpr("review_id", "review_content AS review", "votes_up AS helpful_votes", "language")
    rows.write.partitionBy("language").option("header", True).option("escape", '"').csv(path)
    out = rv.read_by_genre(spark, f"{path}/language=*", r"language=([a-z]+)/[^/]*$", line_breaks=True)
    return out.groupBy("genre").agg(F.count("*").alias("n_rows"), F.sum("votes_up").alias("votes_up"),
                                    F.sum("num_reviews").alias("num_reviews"))


@query("S15", S.with_blocks("""
SELECT appid, count(*) AS n_rows, count(*) FILTER (exclude_reason IS NULL) AS n_kept FROM flagged GROUP BY appid""", "flagged"))
def cleaned_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "cleaned")
    sinks.write_cleaned(V.reviews(spark, sf_dir), path)
    every = sinks.read_cleaned(spark, path, include_flagged=True).groupBy("appid").agg(F.count("*").alias("n_rows"))
    kept = sinks.read_cleaned(spark, path).groupBy("appid").agg(F.count("*").alias("n_kept"))
    return every.join(kept, "appid", "left").na.fill(0)


@query("S16", S.with_blocks("""
SELECT appid, count(*) AS n_scored, count(*) FILTER (risk_level IN ('Critical', 'High')) AS n_high_risk FROM levelled GROUP BY appid""",
    "levelled"))
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "results")
    scored = monitor.score_rows(V.reviews(spark, sf_dir))
    scored = scored.select("appid", "review_id", "sentiment_label", "topic", "risk_score", "risk_level")
    sinks.write_scored(scored, scored.groupBy("appid").agg(F.count("*").alias("n")), path)
    n = spark.read.json(f"{path}/summary").select("appid", F.col("n").alias("n_scored"))
    high = spark.read.csv(f"{path}/high_risk", header=True, inferSchema=False)
    return n.join(high.groupBy("appid").agg(F.count("*").alias("n_high_risk")), "appid", "left").na.fill(0)
