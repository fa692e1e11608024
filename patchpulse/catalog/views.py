"""Review-shaped inputs derived from the supplied tables, as DataFrames (``views``) and as SQL (``catalog.sql``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with long texts, for every core to score its share."""
    return spread(table(spark, sf_dir, name), *{"documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"]}[name])


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per document; a few documents carry content that makes each exclusion rule fire."""
    d = texts(spark, sf_dir, "documents").alias("d")
    e = table(spark, sf_dir, "events").alias("e")
    lab = table(spark, sf_dir, "labels").alias("l")
    joined = d.join(e, F.expr("e.event_id = d.doc_id * 5")).join(lab, F.expr("l.doc_id = d.doc_id"), "left")
    return joined.selectExpr(
        "CAST(d.doc_id AS STRING) AS review_id",
        "d.doc_id AS doc_id",
        "d.source AS appid",
        """CASE WHEN d.doc_id % 97 = 11 THEN NULL
                WHEN d.doc_id % 97 = 12 THEN '   '
                WHEN d.doc_id % 97 = 13 THEN '... !!! ???'
                WHEN d.doc_id % 97 = 14 THEN 'привет как дела'
                WHEN d.doc_id % 97 = 15 THEN concat('sooooooooooooo good ', d.text)
                WHEN d.doc_id % 97 = 16 THEN 'buy buy buy buy buy buy buy buy'
                WHEN d.doc_id % 97 = 17 THEN concat('see http://a.example and https://b.example now ', d.text)
                WHEN d.doc_id % 97 = 18 THEN 'gg wp'
                WHEN d.doc_id % 7 = 3 THEN concat('great fun, not bad &amp; really love it! ', d.text)
                WHEN d.doc_id % 7 = 5 THEN concat('terrible lag and crash after update, but stupid paywall. ', d.text)
                ELSE d.text END AS review_content""",
        "CASE WHEN l.quality IS NOT NULL THEN l.quality = 1 ELSE d.doc_id % 3 <> 0 END AS voted_up",
        "date_trunc('second', CAST(e.ts AS TIMESTAMP)) AS ts",
        "e.user_id AS author_id",
        "e.value * 10 AS playtime_at_review",
        "CAST(e.user_id % 80 AS INT) AS num_reviews",
        "CAST(CASE WHEN e.user_id % 10 = 0 THEN -1 ELSE e.user_id * 2 END AS INT) AS num_games_owned",
        "CAST(d.n_chars % 25 AS INT) AS votes_up",
        "CAST(d.doc_id % 6 AS INT) AS votes_funny",
        "CAST((d.doc_id * 7) % 40 AS INT) AS comment_count",
        "d.lang AS language",
        "l.toxic AS toxic",
    )


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two updates per app, five days apart, so that their windows overlap; the last app has none with comments."""
    return table(spark, sf_dir, "documents").select("source").distinct().selectExpr(
        "source AS appid",
        "explode(array('-u1', '-u2')) AS u",
        """CASE CAST(substring(source, 4) AS INT) % 3
                WHEN 0 THEN TIMESTAMP '2024-01-07 00:00:00'
                WHEN 1 THEN TIMESTAMP '2024-01-08 00:00:00'
                ELSE TIMESTAMP '2024-01-09 00:00:00' END AS first_ts""",
    ).selectExpr(
        "appid",
        "concat(appid, u) AS update_id",
        "if(u = '-u1', first_ts, first_ts + INTERVAL 5 DAYS) AS update_ts",
        "7 AS pre_days",
        "7 AS post_days",
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One news item per event."""
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(event_id AS STRING) AS gid",
        "concat('src', CAST(user_id % 20 AS STRING)) AS appid",
        """CASE event_type WHEN 'purchase' THEN 'Hotfix patch notes' WHEN 'error' THEN 'Weekend sale'
                WHEN 'click' THEN 'Big Update is live' WHEN 'view' THEN 'Community fixes roundup'
                ELSE 'Scheduled maintenance' END AS title""",
        "date_trunc('second', CAST(ts AS TIMESTAMP)) AS published_at",
        "concat('https://news.example/', CAST(event_id AS STRING)) AS url",
        "concat('Changes: ', props) AS contents",
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcement comments; ``position`` is the order on the page."""
    return texts(spark, sf_dir, "conversations").selectExpr(
        "concat('src', CAST(conv_id % 19 AS STRING)) AS appid",
        "CAST(conv_id AS STRING) AS forum_topic_id",
        "concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS comment_id",
        """CASE WHEN turn = 0 AND conv_id % 5 = 0 THEN ' gg '
                WHEN turn = 1 AND conv_id % 5 = 1 THEN 'This comment is awaiting analysis by our system'
                WHEN turn = 0 AND conv_id % 5 = 2 THEN 'dead game, terrible update'
                ELSE text END AS content""",
        "role AS author",
        "CAST(turn AS INT) AS upvotes",
        "conv_id * 1000 + turn AS position",
    )


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partner events, one per conversation; some have no start time and some no comment topic."""
    conv = table(spark, sf_dir, "conversations").select("conv_id").distinct().alias("c")
    e = table(spark, sf_dir, "events").alias("e")
    return conv.join(e, F.expr("e.event_id = c.conv_id * 10")).selectExpr(
        "concat('src', CAST(c.conv_id % 19 AS STRING)) AS appid",
        "concat('g', CAST(c.conv_id AS STRING)) AS gid",
        "CASE WHEN c.conv_id % 11 = 0 THEN '' ELSE CAST(c.conv_id AS STRING) END AS forum_topic_id",
        "CASE WHEN c.conv_id % 13 = 0 THEN NULL ELSE date_trunc('second', CAST(e.ts AS TIMESTAMP)) END AS event_ts",
        "e.event_type AS event_name",
    )


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of scored feedback."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('src', CAST(user_id % 20 AS STRING)) AS appid",
        "event_id",
        "CAST(ts AS TIMESTAMP) AS ts",
        "greatest(-1D, least(1D, (value - 50) / 100)) AS score",
        "event_type",
        "value",
        "user_id",
    )
