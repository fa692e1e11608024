"""Row features of reviews and group-relative scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sentiment, text


def add_text_features(df: DataFrame, content: str = "review_content", lexicon: DataFrame | None = None) -> DataFrame:
    """Processed text, sentiment scores and label. Other features are added from these by column functions."""
    processed = text.clean_text(F.coalesce(content, F.lit("")))
    if "review_content_processed" in df.columns:
        processed = F.coalesce("review_content_processed", processed)
    return sentiment.add_sentiment(df.withColumn("review_content_processed", processed), lexicon=lexicon)


def backfill_sentiment(df: DataFrame, content: str = "review_content", lexicon: DataFrame | None = None) -> DataFrame:
    """Compound of the rows that lack one; the others keep theirs and their texts are not scored. One projection, no join."""
    missing = F.when(F.col("_given").isNull(), text.clean_text(F.coalesce(content, F.lit(""))))
    held = df.withColumnRenamed("compound", "_given").withColumn("_missing", missing)
    scored = sentiment.add_sentiment(held, processed="_missing", lexicon=lexicon)
    return scored.withColumn("compound", F.coalesce("_given", "compound")).select(*df.columns)


def flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def author_columns() -> dict[str, Column]:
    """Author history features, before standardisation."""
    games = F.greatest(F.coalesce("num_games_owned", F.lit(0)), F.lit(0))
    n_reviews = F.coalesce("num_reviews", F.lit(0))
    hours = F.coalesce("played_hours", F.lit(0.0))
    at_review = F.coalesce("playtime_at_review", F.lit(0.0))
    recent = F.coalesce("playtime_last_two_weeks", F.lit(0.0))
    up = F.coalesce("votes_up", F.lit(0))
    return {
        "games_per_review_ratio": games / (n_reviews + 1),
        "hours_per_game_ratio": hours / (games + 1),
        "is_active_reviewer": flag(n_reviews > 10),
        "is_hardcore_gamer": flag(hours > 100),
        "is_casual_gamer": flag(hours <= 10),
        "recent_activity_ratio": recent / (at_review + 1),
        "author_reputation_raw": F.log1p(games.cast("double")) * 0.2 + F.log1p(n_reviews.cast("double")) * 0.3
        + F.log1p(hours.cast("double")) * 0.2,
        "avg_votes_per_review": F.when(n_reviews > 0, up / n_reviews).otherwise(0.0),
    }


def add_author_features(df: DataFrame, quality_votes: float = 5.0, influential_ratio: float = 1.0) -> DataFrame:
    """Author features with the reputation standardised over all rows.

    The two cuts have no published value and are parameters.
    """
    out = df.withColumns(author_columns())
    out = out.withColumns({
        "is_quality_reviewer": flag((F.col("votes_up") >= quality_votes) & (F.col("num_reviews") > 10)),
        "is_influential_reviewer": flag(F.col("avg_votes_per_review") >= influential_ratio),
    })
    return add_global_z(out, "author_reputation_raw", "author_reputation_score").drop("author_reputation_raw")


def engagement_columns() -> dict[str, Column]:
    up = F.coalesce("votes_up", F.lit(0))
    funny = F.coalesce("votes_funny", F.lit(0))
    n_comments = F.coalesce("comment_count", F.lit(0))
    up_log, funny_log, comment_log = (F.log1p(c.cast("double")) for c in (up, funny, n_comments))
    return {
        "votes_up_log": up_log,
        "votes_funny_log": funny_log,
        "comment_count_log": comment_log,
        "is_helpful_review": flag(up >= 5),
        "is_highly_helpful": flag(up >= 20),
        "is_funny_review": flag(funny >= 3),
        "funny_ratio": funny / (up + funny + 1),
        "serious_ratio": up / (up + funny + 1),
        "is_controversial": flag(n_comments >= 10),
        "is_highly_discussed": flag(n_comments >= 30),
        "engagement_score": up_log * 0.5 + funny_log * 0.2 + comment_log * 0.3,
    }


ENGAGEMENT_LEVELS = ("low_engagement", "medium_engagement", "high_engagement", "viral")


def add_engagement_features(df: DataFrame) -> DataFrame:
    """Engagement features, standardised score and quartile level."""
    from ..operators.quantiles import exact_quantiles

    out = df.withColumns(engagement_columns())
    if "weighted_vote_score" in df.columns:
        out = out.withColumn("is_high_quality", flag(F.col("weighted_vote_score") >= 0.7))
    out = add_global_z(out, "engagement_score", "engagement_score_normalized")
    cuts = exact_quantiles(out, "engagement_score", (0.25, 0.5, 0.75)).select(F.struct("*").alias("q")).scalar()
    s, eps = F.col("engagement_score"), F.lit(1e-12)  # scores equal to a cut stay below it
    level = (
        F.when(s <= F.col("_q.p25") + eps, ENGAGEMENT_LEVELS[0]).when(s <= F.col("_q.p50") + eps, ENGAGEMENT_LEVELS[1])
        .when(s <= F.col("_q.p75") + eps, ENGAGEMENT_LEVELS[2]).otherwise(ENGAGEMENT_LEVELS[3])
    )
    return out.withColumn("_q", cuts).withColumn("engagement_level", level).drop("_q")


def contradiction_columns() -> dict[str, Column]:
    """Text that contradicts votes, discussion or the recommendation."""
    from ..operators.windows import disagrees

    c = F.col("compound")
    return {
        "negative_but_helpful": flag((c < -0.3) & (F.col("votes_up") >= 10)),
        "positive_but_unhelpful": flag((c > 0.3) & (F.col("votes_up") <= 1)),
        "controversial_sentiment": flag((F.col("comment_count") >= 10) & (F.abs(c) >= 0.5)),
        "recommendation_sentiment_mismatch": disagrees().cast("int"),
    }


def _safe_z(x: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd > 0, (x - mean) / sd).otherwise(F.lit(0.0))


def add_global_z(df: DataFrame, column: str, name: str) -> DataFrame:
    """z-score over all rows; the statistics are a one-row subquery, not an unpartitioned window."""
    stats = df.agg(F.struct(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"))).scalar()
    return df.withColumn("_z", stats).withColumn(name, _safe_z(F.col(column), F.col("_z.m"), F.col("_z.s"))).drop("_z")


def add_group_z(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """z-score inside groups; group statistics are aggregated map-side and joined back."""
    stats = df.groupBy(*keys).agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    joined = df.join(stats, keys)
    return joined.withColumn(name, _safe_z(F.col(column), F.col("_m"), F.col("_s"))).drop("_m", "_s")


def add_sentiment_interactions(df: DataFrame, keys: list[str]) -> DataFrame:
    """Group z-score of the compound and its products with reputation and bug reports."""
    out = add_group_z(df, keys, "compound", "compound_z")
    extra = {}
    if "author_reputation_score" in df.columns:
        extra["sentiment_x_reputation"] = F.col("compound") * F.col("author_reputation_score")
    if "contains_bug_report" in df.columns:
        extra["sentiment_x_bug"] = F.col("compound") * F.col("contains_bug_report")
    return out.withColumns(extra) if extra else out


def add_risk_features(df: DataFrame, content: str = "review_content_processed") -> DataFrame:
    """Everything the row risk score needs, from scored text and vote counts."""
    return df.withColumns(text.complaint_flags(content)).withColumns(contradiction_columns())
