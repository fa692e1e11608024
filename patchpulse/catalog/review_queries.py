"""Registered queries: scans, filters, cleaning, text and row features, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import features, text
from ..operators import aggregates, cleaning, comments as comment_ops, joins, risk, windows
from ..plans import impact, relabel
from . import sql as S
from . import views as V
from .registry import iso, query, r6

KEYS = ["appid", "update_id"]


def scored_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_text_features(V.reviews(spark, sf_dir))


def scored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.scored_windows(V.reviews(spark, sf_dir), V.updates(spark, sf_dir))


def comment_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.nearest_comment_source(
        V.updates(spark, sf_dir), V.announcements(spark, sf_dir), windows.patch_notes(V.news(spark, sf_dir)),
        V.comments(spark, sf_dir))


# --------------------------------------------------------------------------------------------- scans, filters


@query("F1, K1", S.with_blocks(f"""
SELECT review_id, appid, {S.iso('ts')} AS ts, voted_up, votes_up FROM reviews_v
WHERE appid = 'src3' AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'""", "reviews_v"))
def review_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = windows.scan_range(V.reviews(spark, sf_dir), "src3", "2024-01-05 00:00:00", "2024-01-12 00:00:00")
    return hit.select("review_id", "appid", iso("ts").alias("ts"), "voted_up", "votes_up")


@query("F2, J4, U1", S.with_blocks(
    f'SELECT review_id, appid, update_id, "window", {S.iso("ts")} AS ts FROM tagged', "tagged"))
def review_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.split_windows(V.reviews(spark, sf_dir), V.updates(spark, sf_dir))
    return out.select("review_id", "appid", "update_id", "window", iso("ts").alias("ts"))


@query("F3", S.with_blocks(f"""
SELECT review_id, appid, {S.iso('ts')} AS ts, CAST(k AS INT) AS recency_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY appid ORDER BY ts DESC, review_id) AS k FROM reviews_v) WHERE k <= 25""",
    "reviews_v"))
def latest_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.latest_per_app(V.reviews(spark, sf_dir), 25)
    return out.select("review_id", "appid", iso("ts").alias("ts"), "recency_rank")


@query("F4, U3", S.with_blocks(f"SELECT gid, appid, title, {S.iso('published_at')} AS published_at FROM notes_v "
                               "WHERE published_at >= TIMESTAMP '2024-01-03 00:00:00'", "notes_v"))
def patch_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.patch_notes(V.news(spark, sf_dir), F.lit("2024-01-03 00:00:00").cast("timestamp"))
    return out.select("gid", "appid", "title", iso("published_at").alias("published_at"))


@query("F5, G11", S.with_blocks(
    "SELECT appid, forum_topic_id, count(*) AS n_comments FROM comments_v GROUP BY ALL", "comments_v"))
def comment_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.topic_ids(V.comments(spark, sf_dir))


@query("F6", S.with_blocks(
    "SELECT appid, update_id, comment_id, md5(content) AS content_md5, position FROM comm_kept", "comm_kept"))
def comment_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = joins.comments_of_updates(V.comments(spark, sf_dir), comment_sources(spark, sf_dir))
    out = comment_ops.prefilter(joined, KEYS)
    return out.select(*KEYS, "comment_id", F.md5("content").alias("content_md5"), "position")


@query("F6", S.with_blocks(f"""
SELECT appid, n_raw, n_kept, n_raw - n_kept AS n_removed FROM (
  SELECT appid, count(*) AS n_raw, count(DISTINCT CASE WHEN length(body) >= 5
           AND NOT regexp_matches(body, '(?i)^This comment is awaiting analysis') THEN body END) AS n_kept
  FROM (SELECT appid, {S.strip("content")} AS body FROM comments_v) GROUP BY appid)""", "comments_v"))
def comment_prefilter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comment_ops.prefilter_counts(V.comments(spark, sf_dir), ["appid"])


@query("F7", S.with_blocks("""
SELECT appid, update_id, review_id, compound, k AS queue_pos FROM (
  SELECT *, row_number() OVER (PARTITION BY appid, update_id ORDER BY ts, review_id) AS k FROM scored
  WHERE "window" = 'post' AND compound BETWEEN -0.2 AND 0.2)""", "scored"))
def gray_zone_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = scored_windows(spark, sf_dir).where("window = 'post'")
    return windows.gray_queue(post, KEYS).select(*KEYS, "review_id", "compound", "queue_pos")


@query("F8", S.with_blocks("""
SELECT appid, update_id, "window", count(*) AS n_rows,
       count(*) FILTER ((compound > 0.05 AND NOT voted_up) OR (compound < -0.05 AND voted_up)) AS n_disagreements,
       round_even(count(*) FILTER ((compound > 0.05 AND NOT voted_up) OR (compound < -0.05 AND voted_up))
         / greatest(count(*), 1), 4) AS disagreement_pct
FROM scored GROUP BY ALL""", "scored"))
def vote_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.disagreement_stats(scored_windows(spark, sf_dir), [*KEYS, "window"])


@query("F9", S.with_blocks(
    "SELECT review_id, CASE WHEN voted_up THEN 9.0::DOUBLE ELSE compound END AS compound FROM rev_s", "rev_s"))
def feature_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = V.reviews(spark, sf_dir).select("review_id", "review_content", F.expr("if(voted_up, 9D, NULL)").alias("compound"))
    return features.backfill_sentiment(base).select("review_id", "compound")


# --------------------------------------------------------------------------------------------- cleaning


@query("C1-C7, S15", S.with_blocks(
    "SELECT review_id, appid, exclude_reason, CAST(exclude_reason IS NOT NULL AS INT) AS is_removed_cleaning FROM flagged",
    "flagged"))
def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cleaning.flag_rows(V.reviews(spark, sf_dir))
    return out.select("review_id", "appid", "exclude_reason", "is_removed_cleaning")


@query("C8", S.with_blocks("""
SELECT appid, coalesce(exclude_reason, 'kept') AS exclude_reason, count(*) AS n_rows FROM flagged GROUP BY ALL""", "flagged"))
def exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.reason_counts(cleaning.flag_rows(V.reviews(spark, sf_dir)), ["appid"])


# --------------------------------------------------------------------------------------------- text features


@query("X1", S.with_blocks("SELECT review_id, md5(processed) AS processed_md5 FROM rev_p", "rev_p"))
def processed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.reviews(spark, sf_dir).select(
        "review_id", text.clean_text(F.coalesce("review_content", F.lit(""))).alias("p"))
    return out.select("review_id", F.md5("p").alias("processed_md5"))


@query("X2, X3, X6", S.with_blocks("""
SELECT review_id, compound, pos, neu, neg, sentiment_label,
       CASE sentiment_label WHEN 'negative' THEN 0 WHEN 'positive' THEN 2 ELSE 1 END AS label_code,
       voted_up AS is_recommended FROM rev_s""", "rev_s"))
def sentiment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.sentiment import label_code

    return scored_reviews(spark, sf_dir).select(
        "review_id", "compound", "pos", "neu", "neg", "sentiment_label",
        label_code("sentiment_label").alias("label_code"), F.col("voted_up").cast("boolean").alias("is_recommended"),
    )


@query("X2", S.with_blocks("SELECT review_id, compound, pos, neu, neg, sentiment_label FROM rev_s", "rev_s"))
def sentiment_scores_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import sentiment

    base = V.reviews(spark, sf_dir).select(
        "review_id", text.clean_text(F.coalesce("review_content", F.lit(""))).alias("p"))
    out = sentiment.add_sentiment_relational(base, ["review_id"], "p", sentiment.default_lexicon(spark))
    return out.select("review_id", "compound", "pos", "neu", "neg", "sentiment_label")


@query("X2", S.with_blocks("SELECT review_id, compound, pos, neu, neg, sentiment_label FROM loud_s", "loud_s"))
def cased_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import phrases

    rows = V.reviews(spark, sf_dir).select("review_id", F.expr(S.LOUD).alias("content"))
    return phrases.add_cased_sentiment(rows, "content").drop("content")


_RAW = "coalesce(review_content, '')"
_SENT = f"len(regexp_extract_all({_RAW}, '[^.!?]*[^.!?\\s][^.!?]*'))"


@query("X4, X7", S.with_blocks(f"""
SELECT review_id, length(processed) AS char_count, len(ws) AS word_count,
       CASE WHEN len(ws) > 0 THEN {S.s6("length(replace(processed, ' ', '')) / len(ws)")} ELSE 0.0 END AS avg_word_length,
       length({_RAW}) AS text_length, {_SENT} AS sentence_count,
       length({_RAW}) - length(replace({_RAW}, '!', '')) AS exclamation_count,
       length({_RAW}) - length(replace({_RAW}, '?', '')) AS question_count,
       CASE WHEN length({_RAW}) > 0 THEN {S.s6(f"len(regexp_extract_all({_RAW}, '\\p{{Lu}}')) / length({_RAW})")}
            ELSE 0.0 END AS uppercase_ratio,
       CASE WHEN length({_RAW}) > 0 THEN {S.s6(f"len(regexp_extract_all({_RAW}, '[.,!?;:]')) / length({_RAW})")}
            ELSE 0.0 END AS punctuation_ratio,
       CAST(contains({_RAW}, '?') AS INT) AS has_question,
       CAST(regexp_matches({_RAW}, 'https?://\\S+|www\\.\\S+') AS INT) AS has_url,
       CAST(regexp_matches({_RAW}, '@[A-Za-z0-9_]+') AS INT) AS has_mention,
       CAST(regexp_matches({_RAW}, 'https?://\\S+|www\\.\\S+|@[A-Za-z0-9_]+') AS INT) AS has_external_reference
FROM (SELECT *, list_filter(string_split(processed, ' '), lambda w: w <> '') AS ws FROM rev_p)""", "rev_p"))
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = V.reviews(spark, sf_dir).withColumn("p", text.clean_text(F.coalesce("review_content", F.lit(""))))
    cols = text.char_and_word_stats("p") | text.surface_stats("review_content")
    rounded = ("avg_word_length", "uppercase_ratio", "punctuation_ratio")
    out = base.select("review_id", *[c.alias(n) for n, c in cols.items()])
    return out.select("review_id", *[
        (F.when(F.col(n) == 0, 0.0).otherwise(r6(n)).alias(n) if n in rounded
         else F.col(n).cast("int" if n.startswith("has_") else "bigint").alias(n)) for n in cols
    ])


_NW, _NS = "len(ws)", "greatest(len(regexp_extract_all(processed, '[^.!?]*[^.!?\\s][^.!?]*')), 1)"
_NY = "len(regexp_extract_all(lower(processed), '[aeiouy]+'))"


@query("X5", S.with_blocks(f"""
SELECT review_id,
  {S.s6(f"CASE WHEN {_NW} > 0 THEN 206.835::DOUBLE - 1.015::DOUBLE * ({_NW} / {_NS}) - 84.6::DOUBLE * ({_NY} / {_NW}) ELSE 0.0::DOUBLE END")} AS flesch_reading_ease,
  {S.s6(f"CASE WHEN {_NW} > 0 THEN 0.39::DOUBLE * ({_NW} / {_NS}) + 11.8::DOUBLE * ({_NY} / {_NW}) - 15.59::DOUBLE ELSE 0.0::DOUBLE END")} AS flesch_kincaid_grade
FROM (SELECT *, list_filter(string_split(processed, ' '), lambda w: w <> '') AS ws FROM rev_p)""", "rev_p"))
def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = V.reviews(spark, sf_dir).withColumn("p", text.clean_text(F.coalesce("review_content", F.lit(""))))
    return base.select("review_id", *[r6(c).alias(n) for n, c in text.readability("p").items()])


def _word_hits(words) -> str:
    return (f"len(list_filter(string_split_regex(lower(processed), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+'), "
            f"lambda w: w IN ({', '.join(repr(x) for x in words)})))")


@query("X8-X10", S.with_blocks(f"""
SELECT review_id, {S.flags('processed')}, {S.kw('processed', config.TOXIC_WORDS)}::INT * 0.7::DOUBLE AS toxicity_score,
       {_word_hits(config.NEGATION_WORDS)} AS negation_count, {_word_hits(config.INTENSIFIER_WORDS)} AS intensifier_count
FROM rev_p""", "rev_p"))
def complaint_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = V.reviews(spark, sf_dir).withColumn("p", text.clean_text(F.coalesce("review_content", F.lit(""))))
    counts = {n: c.cast("bigint") for n, c in text.emphasis_counts("p").items()}
    return base.select("review_id", *[c.alias(n) for n, c in (text.complaint_flags("p") | counts).items()])


@query("X9", S.with_blocks("""
SELECT CAST(l.toxic AS INT) AS toxic, r.is_toxic, count(*) AS n_rows
FROM risk_rows r JOIN labels l USING (doc_id) GROUP BY ALL""", "risk_rows"))
def toxicity_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = V.reviews(spark, sf_dir).where("toxic IS NOT NULL")
    flag = text.complaint_flags("p")["is_toxic"]
    rows = base.withColumn("p", text.clean_text(F.coalesce("review_content", F.lit("")))).withColumn("is_toxic", flag)
    return rows.groupBy("toxic", "is_toxic").agg(F.count("*").alias("n_rows"))


S.block("author", """
SELECT *, ln(1 + g)::DOUBLE * 0.2::DOUBLE + ln(1 + num_reviews) * 0.3::DOUBLE + ln(1 + h) * 0.2::DOUBLE AS rep FROM (
  SELECT *, greatest(num_games_owned, 0) AS g, playtime_at_review / 60 AS h, playtime_at_review / 10 AS w2 FROM reviews_v)
""", "reviews_v")


@query("X11, W11", S.with_blocks(f"""
SELECT review_id, {S.s6('g / (num_reviews + 1)')} AS games_per_review_ratio, {S.s6('h / (g + 1)')} AS hours_per_game_ratio,
       CAST(num_reviews > 10 AS INT) AS is_active_reviewer, CAST(h > 100 AS INT) AS is_hardcore_gamer,
       CAST(h <= 10 AS INT) AS is_casual_gamer, {S.s6('w2 / (playtime_at_review + 1)')} AS recent_activity_ratio,
       {S.s6('CASE WHEN num_reviews > 0 THEN votes_up / num_reviews ELSE 0.0 END')} AS avg_votes_per_review,
       CAST(votes_up >= 5 AND num_reviews > 10 AS INT) AS is_quality_reviewer,
       CAST(CASE WHEN num_reviews > 0 THEN votes_up / num_reviews ELSE 0.0 END >= 1 AS INT) AS is_influential_reviewer,
       {S.s6('(rep - (SELECT avg(rep) FROM author)) / (SELECT stddev_samp(rep) FROM author)')} AS author_reputation_score
FROM author""", "author"))
def author_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = V.reviews(spark, sf_dir).withColumns({
        "played_hours": F.col("playtime_at_review") / 60, "playtime_last_two_weeks": F.col("playtime_at_review") / 10
    })
    out = features.add_author_features(base)
    floats = ("games_per_review_ratio", "hours_per_game_ratio", "recent_activity_ratio", "avg_votes_per_review",
              "author_reputation_score")
    flags = ("is_active_reviewer", "is_hardcore_gamer", "is_casual_gamer", "is_quality_reviewer",
             "is_influential_reviewer")
    return out.select("review_id", *[r6(c).alias(c) for c in floats], *flags)


S.block("engaged", """
SELECT *, ln(1 + votes_up) * 0.5::DOUBLE + ln(1 + votes_funny) * 0.2::DOUBLE + ln(1 + comment_count) * 0.3::DOUBLE AS es
FROM reviews_v""", "reviews_v")


@query("X12", S.with_blocks(f"""
SELECT review_id, {S.s6('ln(1 + votes_up)')} AS votes_up_log, {S.s6('ln(1 + votes_funny)')} AS votes_funny_log,
       {S.s6('ln(1 + comment_count)')} AS comment_count_log,
       CAST(votes_up >= 5 AS INT) AS is_helpful_review, CAST(votes_up >= 20 AS INT) AS is_highly_helpful,
       CAST(votes_funny >= 3 AS INT) AS is_funny_review,
       {S.s6('votes_funny / (votes_up + votes_funny + 1)')} AS funny_ratio,
       {S.s6('votes_up / (votes_up + votes_funny + 1)')} AS serious_ratio,
       CAST(comment_count >= 10 AS INT) AS is_controversial, CAST(comment_count >= 30 AS INT) AS is_highly_discussed,
       {S.s6('es')} AS engagement_score,
       {S.s6('(es - (SELECT avg(es) FROM engaged)) / (SELECT stddev_samp(es) FROM engaged)')} AS engagement_score_normalized,
       CASE WHEN es <= q[1] + 1e-12 THEN 'low_engagement' WHEN es <= q[2] + 1e-12 THEN 'medium_engagement'
            WHEN es <= q[3] + 1e-12 THEN 'high_engagement' ELSE 'viral' END AS engagement_level
FROM engaged, (SELECT quantile_cont(es, [0.25, 0.5, 0.75]) AS q FROM engaged)""", "engaged"))
def engagement_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.add_engagement_features(V.reviews(spark, sf_dir))
    floats = ("votes_up_log", "votes_funny_log", "comment_count_log", "funny_ratio", "serious_ratio",
              "engagement_score", "engagement_score_normalized")
    rest = ("is_helpful_review", "is_highly_helpful", "is_funny_review", "is_controversial", "is_highly_discussed",
            "engagement_level")
    return out.select("review_id", *[r6(c).alias(c) for c in floats], *rest)


@query("X13", S.with_blocks(f"SELECT review_id, {S.CONTRADICTIONS} FROM rev_s", "rev_s"))
def contradiction_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored_reviews(spark, sf_dir)
    return out.select("review_id", *[c.alias(n) for n, c in features.contradiction_columns().items()])


@query("X14", S.with_blocks(f"""
SELECT review_id, CASE WHEN sd > 0 THEN {S.s6('(compound - m) / nullif(sd, 0)')} ELSE round(1e-9, 6) END AS compound_z,
       {S.s6('compound * contains_bug_report')} AS sentiment_x_bug,
       {S.s6('compound * (ln(1 + num_reviews))')} AS sentiment_x_reputation
FROM (SELECT *, avg(compound) OVER (PARTITION BY appid) AS m, stddev_samp(compound) OVER (PARTITION BY appid) AS sd
      FROM risk_rows)""", "risk_rows"))
def sentiment_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.add_risk_features(scored_reviews(spark, sf_dir)).withColumn(
        "author_reputation_score", F.log1p(F.col("num_reviews").cast("double")))
    out = features.add_sentiment_interactions(rows, ["appid"])
    cols = ("compound_z", "sentiment_x_bug", "sentiment_x_reputation")
    return out.select("review_id", *[r6(c).alias(c) for c in cols])


# --------------------------------------------------------------------------------------------- statistics


@query("G1", S.with_blocks(f"""
SELECT appid, update_id, "window", {S.s6('avg(compound)')} AS mean_compound,
       {', '.join(f"{S.s6(f'''avg(CASE WHEN sentiment_label = '{v}' THEN 1.0::DOUBLE ELSE 0 END)''')} AS {v}_pct" for v in aggregates.LABELS)},
       count(*) AS n_reviews FROM scored GROUP BY ALL""", "scored"))
def sentiment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.sentiment_stats(scored_windows(spark, sf_dir), [*KEYS, "window"])
    cols = ["mean_compound", *[f"{v}_pct" for v in aggregates.LABELS]]
    return out.select(*KEYS, "window", *[r6(c).alias(c) for c in cols], "n_reviews")


@query("G2", S.with_blocks("SELECT appid, update_id, pre_n, post_n, sentiment_delta FROM stats", "stats"))
def sentiment_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.window_stats(scored_windows(spark, sf_dir), V.updates(spark, sf_dir))
    return out.select(*KEYS, "pre_n", "post_n", "sentiment_delta")


S.block("topics", f"""
SELECT appid, update_id, label, count(*) AS "count",
       round_even(count(*) / sum(count(*)) OVER (PARTITION BY appid, update_id), 4) AS pct
FROM (SELECT *, {S.topic_case('processed')} AS label FROM scored WHERE "window" = 'post') GROUP BY appid, update_id, label""", "scored")
S.block("themes", f"""
SELECT appid, update_id, {S.topic_case('processed')} AS label, count(*) AS "count" FROM com_s GROUP BY ALL""", "com_s")


@query("G3, L1", S.with_blocks("SELECT * FROM topics", "topics"))
def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = scored_windows(spark, sf_dir).where("window = 'post'")
    return aggregates.topic_counts(post.withColumn("topic", text.keyword_topic("review_content_processed")), KEYS)


@query("L1", S.with_blocks("""
SELECT appid, label AS topic, count(*) AS n_rows FROM (
  SELECT appid, CASE WHEN contains(processed, 'lag') THEN 'performance'
                     WHEN contains(processed, 'love') THEN 'gameplay' ELSE 'other' END AS label
  FROM rev_p) GROUP BY ALL""", "rev_p"))
def topic_counts_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    def classify(texts: list[str]) -> list[str]:
        return ["performance" if "lag" in t else "gameplay" if "love" in t else "weather" for t in texts]

    base = V.reviews(spark, sf_dir).select(
        "appid", text.clean_text(F.coalesce("review_content", F.lit(""))).alias("p"))
    out = comment_ops.apply_labeller(
        base, "p", "topic", classify, config.TOPIC_LABELS, "other", config.TOPIC_BATCH)
    return out.groupBy("appid", "topic").agg(F.count("*").alias("n_rows"))


def announcement_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = joins.comments_of_updates(V.comments(spark, sf_dir), comment_sources(spark, sf_dir))
    labelled = comment_ops.label_comments(comment_ops.prefilter(joined, KEYS))
    return labelled.groupBy(*KEYS, F.col("theme").alias("label")).agg(F.count("*").alias("count"))


S.block("ranked_topics", """
SELECT appid, update_id, label, "count", pct, CAST(row_number() OVER (PARTITION BY appid, update_id ORDER BY "count" DESC, label) AS INT) AS rank
FROM (SELECT * FROM topics UNION ALL SELECT appid, update_id, '[announcement] ' || label, "count", 0.0 FROM themes)""", "topics", "themes")


@query("G4", S.with_blocks("SELECT * FROM ranked_topics", "ranked_topics"))
def merged_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.merge_announcement_themes(
        topic_counts(spark, sf_dir), announcement_themes(spark, sf_dir), KEYS)


@query("K2", S.with_blocks("SELECT * FROM ranked_topics WHERE rank <= 3", "ranked_topics"))
def top_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.merge_announcement_themes(
        topic_counts(spark, sf_dir), announcement_themes(spark, sf_dir), KEYS, k=3)


@query("G5, X16", S.with_blocks(f"""
SELECT b.appid, b."window", n_total, n_recommended, n_short, {S.s6('m')} AS mean_compound, {S.s6('md')} AS median_compound,
       {S.s6('sd')} AS std_compound, coalesce(top_short, '') AS top_short
FROM (SELECT appid, "window", count(*) AS n_total, count(*) FILTER (voted_up) AS n_recommended,
             count(*) FILTER (length(review_content) < 10) AS n_short, avg(compound) AS m,
             median(compound) AS md, stddev_samp(compound) AS sd FROM scored GROUP BY ALL) b
LEFT JOIN (SELECT appid, "window", string_agg(n || ' x "' || st || '"', ', ' ORDER BY k) AS top_short FROM (
    SELECT *, row_number() OVER (PARTITION BY appid, "window" ORDER BY n DESC, st) AS k FROM (
      SELECT appid, "window", {S.strip('review_content')} AS st, count(*) AS n FROM scored
      WHERE length(review_content) < 10 GROUP BY ALL)) WHERE k <= 8 GROUP BY ALL) t
  ON t.appid = b.appid AND t."window" = b."window" """, "scored"))
def distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.distribution_summary(scored_windows(spark, sf_dir), ["appid", "window"])
    return out.select("appid", "window", "n_total", "n_recommended", "n_short",
                      *[r6(c).alias(c) for c in ("mean_compound", "median_compound", "std_compound")], "top_short")


@query("G6", S.with_blocks("""
SELECT appid, label, "count", CAST(k AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY appid ORDER BY "count" DESC, label) AS k FROM (
    SELECT appid, label, CAST(sum("count") AS BIGINT) AS "count" FROM (
      SELECT concat('src', user_id % 20) AS appid, event_type AS label, coalesce(CAST(user_id % 3 + 1 AS BIGINT), 1) AS "count"
      FROM events) GROUP BY ALL)) WHERE k <= 10"""))
def merged_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = V.table(spark, sf_dir, "events").selectExpr(
        "concat('src', CAST(user_id % 20 AS STRING)) AS appid", "concat(' ', upper(event_type), ' ') AS label",
        "nullif(CAST(user_id % 3 + 1 AS BIGINT), 1) AS count")
    return aggregates.merge_themes(raw, ["appid"])


@query("G7", S.with_blocks(f"""
SELECT appid, md5(txt) AS text_md5, position, sentiment, CAST(k AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY appid ORDER BY position, txt) AS k FROM (
    SELECT appid, {S.strip('content')} AS txt, min(position) AS position, arg_min(author, position) AS sentiment
    FROM comments_v WHERE {S.strip('content')} <> '' GROUP BY ALL)) WHERE k <= 10""", "comments_v"))
def representative_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = V.comments(spark, sf_dir).withColumnsRenamed({"content": "text", "author": "sentiment"})
    out = aggregates.pick_quotes(quotes, ["appid"], "position")
    return out.select("appid", F.md5("text").alias("text_md5"), "position", "sentiment", "rank")


@query("G8, L3", S.with_blocks("SELECT * FROM comm_stats", "comm_stats"))
def comment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.update_comments(V.comments(spark, sf_dir), comment_sources(spark, sf_dir))


@query("G8, G9, L3", S.with_blocks("""
SELECT appid, update_id, CAST(sum(total) AS BIGINT) AS n_comments, CAST(sum(p) AS BIGINT) AS positive_count,
       CAST(sum(u) AS BIGINT) AS neutral_count, CAST(sum(g) AS BIGINT) AS negative_count, count(*) AS n_chunks,
       count(*) FILTER (p + g + u > 0) AS n_analysed,
       round_even(sum(p) / greatest(sum(total), 1), 4) AS positive_pct,
       round_even(sum(u) / greatest(sum(total), 1), 4) AS neutral_pct,
       round_even(sum(g) / greatest(sum(total), 1), 4) AS negative_pct
FROM (SELECT appid, update_id, chunk, count(*) AS total,
             CASE WHEN count(*) < 3 THEN 0 ELSE count(*) FILTER (NOT contains(content, 'dead') AND length(content) % 2 = 1) END AS p,
             CASE WHEN count(*) < 3 THEN 0 ELSE count(*) FILTER (NOT contains(content, 'dead') AND length(content) % 2 = 0) END AS u,
             CASE WHEN count(*) < 3 THEN 0 ELSE count(*) FILTER (contains(content, 'dead')) END AS g
      FROM (SELECT *, (row_number() OVER (PARTITION BY appid, update_id ORDER BY position, comment_id) - 1) // 50 AS chunk
            FROM comm_kept) GROUP BY ALL) GROUP BY ALL""", "comm_kept"))
def chunked_comment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    def analyse(texts: list[str]) -> dict:
        if len(texts) < 3:
            raise ValueError("too small to analyse")
        dead = sum("dead" in t for t in texts)
        odd = sum("dead" not in t and len(t) % 2 == 1 for t in texts)
        return {"sentiment": {"positive": odd, "neutral": len(texts) - dead - odd, "negative": dead}}

    joined = joins.comments_of_updates(V.comments(spark, sf_dir), comment_sources(spark, sf_dir))
    chunked = comment_ops.add_chunks(comment_ops.prefilter(joined, KEYS), KEYS)
    return aggregates.comment_stats(comment_ops.analyse_chunks(chunked, KEYS, analyse), KEYS)


@query("G10", S.with_blocks(f"""
SELECT appid, count(*) AS n_reviews, {S.iso('min(ts)')} AS first_ts, {S.iso('max(ts)')} AS last_ts FROM reviews_v
GROUP BY appid""", "reviews_v"))
def store_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.store_summary(V.reviews(spark, sf_dir))
    return out.select("appid", "n_reviews", iso("first_ts").alias("first_ts"), iso("last_ts").alias("last_ts"))


@query("G12", S.with_blocks(f"""
SELECT appid, strftime(ts, '%Y-%m-%d') AS day, "window", {S.s6('avg(compound)')} AS mean_compound, count(*) AS n_reviews
FROM scored GROUP BY ALL""", "scored"))
def daily_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.daily_sentiment(scored_windows(spark, sf_dir))
    return out.select("appid", F.date_format("day", "yyyy-MM-dd").alias("day"), "window",
                      r6("mean_compound").alias("mean_compound"), "n_reviews")


@query("G16", S.with_blocks("""
SELECT u.appid, u.update_id, coalesce(n_pre, 0) AS n_pre, coalesce(n_post, 0) AS n_post, coalesce(n_notes, 0) AS n_notes,
       coalesce(n_comments, 0) AS n_comments, CAST(datediff('day', u.update_ts, TIMESTAMP '2024-06-01') AS INT) AS age_days,
       coalesce(first_ts <= u.update_ts - INTERVAL 7 DAY AND last_ts >= u.update_ts + INTERVAL 7 DAY, false) AS window_covered,
       CASE WHEN coalesce(n_pre, 0) = 0 OR coalesce(n_post, 0) = 0 THEN
         'WARN: update is ' || datediff('day', u.update_ts, TIMESTAMP '2024-06-01') || ' days old, no ' ||
         concat_ws(' or ', CASE WHEN coalesce(n_pre, 0) = 0 THEN 'pre-update' END,
                           CASE WHEN coalesce(n_post, 0) = 0 THEN 'post-update' END) || ' reviews' END AS warning
FROM updates_v u
LEFT JOIN (SELECT appid, update_id, count(*) FILTER ("window" = 'pre') AS n_pre,
                  count(*) FILTER ("window" = 'post') AS n_post FROM tagged GROUP BY ALL) t USING (appid, update_id)
LEFT JOIN (SELECT appid, min(ts) AS first_ts, max(ts) AS last_ts FROM reviews_v GROUP BY ALL) s ON s.appid = u.appid
LEFT JOIN (SELECT v.update_id, count(*) AS n_notes FROM updates_v v JOIN notes_v n ON n.appid = v.appid
           AND n.published_at >= v.update_ts - INTERVAL 7 DAY GROUP BY ALL) n ON n.update_id = u.update_id
LEFT JOIN (SELECT appid, count(*) AS n_comments FROM comments_v GROUP BY ALL) c ON c.appid = u.appid""",
    "tagged", "notes_v", "comments_v"))
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews, updates = V.reviews(spark, sf_dir), V.updates(spark, sf_dir)
    return aggregates.coverage_report(
        updates, windows.split_windows(reviews, updates), aggregates.store_summary(reviews),
        windows.patch_notes(V.news(spark, sf_dir)), V.comments(spark, sf_dir),
        F.lit("2024-06-01 00:00:00").cast("timestamp"))


@query("G17", S.with_blocks(f"""
SELECT s.appid, s.update_id, post_n AS post_reviews, post_n - pre_n AS post_reviews_change,
       {S.s6('post_negative')} AS negative_pct, {S.s6('post_negative - pre_negative')} AS negative_pct_change,
       sentiment_delta, overall_risk FROM stats s JOIN overall USING (appid, update_id)""", "stats", "overall"))
def kpi_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .impact_queries import report

    out = aggregates.kpi_row(report(spark, sf_dir).summary)
    return out.select(*KEYS, "post_reviews", "post_reviews_change", r6("negative_pct").alias("negative_pct"),
                      r6("negative_pct_change").alias("negative_pct_change"), "sentiment_delta", "overall_risk")


_FS = {"sentiment": ["compound", "pos", "neg"], "votes": ["votes_up", "votes_funny"], "author": ["num_reviews"]}


@query("G18", S.with_blocks(" UNION ALL ".join(
    f"SELECT '{g}' AS feature_group, '{c}' AS feature, count({c}) AS n, {S.s6(f'avg({c})')} AS mean, "
    f"{S.s6(f'stddev_samp({c})')} AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM rev_s"
    for g, cols in _FS.items() for c in cols), "rev_s"))
def feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.feature_summary(scored_reviews(spark, sf_dir), _FS)
    return out.select("feature_group", "feature", "n", r6("mean").alias("mean"), r6("std").alias("std"), "min", "max")


# --------------------------------------------------------------------------------------------- joins


@query("J1, J2", S.with_blocks("SELECT * FROM comment_source", "comment_source"))
def nearest_comment_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comment_sources(spark, sf_dir)


@query("J3", S.with_blocks("""
SELECT appid, comment_id, source_priority FROM (
  SELECT *, min(source_priority) OVER (PARTITION BY appid, forum_topic_id) AS best FROM (
    SELECT appid, forum_topic_id, comment_id, 0 AS source_priority FROM comments_v WHERE author = 'user' AND position % 1000 > 1
    UNION ALL SELECT appid, forum_topic_id, comment_id, 1 FROM comments_v WHERE author = 'assistant'
    UNION ALL SELECT appid, forum_topic_id, comment_id, 2 FROM comments_v)) WHERE source_priority = best""", "comments_v"))
def comment_source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.comments(spark, sf_dir)
    sources = [c.where("author = 'user' AND position % 1000 > 1"), c.where("author = 'assistant'"), c]
    return joins.first_source(sources, ["appid", "forum_topic_id"]).select("appid", "comment_id", "source_priority")


def second_opinion(texts: list[str]) -> list[str]:
    return ["negative" if "lag" in t else "positive" if "tion" in t else "unsure" for t in texts]


S.block("relabelled", """
SELECT * REPLACE (CASE WHEN "window" = 'post' AND compound BETWEEN -0.2 AND 0.2 THEN
    CASE WHEN contains(processed, 'lag') THEN 'negative' WHEN contains(processed, 'tion') THEN 'positive' ELSE 'neutral' END
  ELSE sentiment_label END AS sentiment_label) FROM scored""", "scored")
S.window_stats("relabelled_windows", "relabelled")
S.block("relabelled_with_comments", """
SELECT s.*, c.negative_pct AS cneg, c.n_comments FROM relabelled_windows s LEFT JOIN comm_stats c USING (appid, update_id)""",
        "relabelled_windows", "comm_stats")


@query("J8, L2", S.with_blocks(f"""
SELECT appid, update_id, {', '.join(f"{S.s6(f'''avg(CASE WHEN lab = '{v}' THEN 1.0::DOUBLE ELSE 0 END)''')} AS {v}_pct" for v in aggregates.LABELS)},
       count(*) AS n_reviews
FROM (SELECT *, sentiment_label AS lab FROM relabelled WHERE "window" = 'post') GROUP BY appid, update_id""", "relabelled"))
def relabelled_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = scored_windows(spark, sf_dir).where("window = 'post'")
    out = aggregates.sentiment_stats(relabel.relabel_gray(post, second_opinion), KEYS)
    return out.select(*KEYS, *[r6(f"{v}_pct").alias(f"{v}_pct") for v in aggregates.LABELS], "n_reviews")


@query("L2", S.with_blocks(f"""
SELECT *, {S.RANK} AS severity_rank FROM (
  SELECT *, 'initial' AS stage FROM ({S.SIGNALS.format(src='with_comments')})
  UNION ALL SELECT *, 'relabelled' FROM ({S.SIGNALS.format(src='relabelled_with_comments')}))""", "with_comments", "relabelled_with_comments"))
def relabelled_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    comm = impact.update_comments(V.comments(spark, sf_dir), comment_sources(spark, sf_dir))
    return relabel.relabelled_signals(scored_windows(spark, sf_dir), V.updates(spark, sf_dir), comm, second_opinion).drop("description")


@query("J11", S.with_blocks("""
SELECT r.review_id, r.appid, coalesce(a.name, 'App ' || r.appid) AS app_name, coalesce(a.developer, 'Unknown') AS developer
FROM reviews_v r LEFT JOIN (SELECT concat('src', CAST(n_nationkey AS VARCHAR)) AS appid, n_name AS name, r_name AS developer
  FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey >= 5) a ON a.appid = r.appid""", "reviews_v"))
def app_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = V.table(spark, sf_dir, "nation"), V.table(spark, sf_dir, "region")
    apps = nation.where("n_nationkey >= 5").join(region, F.expr("r_regionkey = n_regionkey")).selectExpr(
        "concat('src', CAST(n_nationkey AS STRING)) AS appid", "n_name AS name", "r_name AS developer")
    return joins.attach_app_info(V.reviews(spark, sf_dir), apps).select("review_id", "appid", "app_name", "developer")


@query("R6, K4", S.with_blocks("SELECT * FROM overall", "overall"))
def overall_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .impact_queries import report

    return risk.overall_risk(report(spark, sf_dir).signals, V.updates(spark, sf_dir))
