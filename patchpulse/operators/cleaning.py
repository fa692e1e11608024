"""Exclusion rules with one explainable reason per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# The names of the reasons.
REASONS = (
    "null_or_empty",
    "punctuation_only",
    "non_english",
    "repeated_char",
    "repetitive_words",
    "multiple_urls",
    "behavioral_spam",
)


def exclude_reason(df: DataFrame, content: str = "review_content") -> Column:
    """The reason a row is unusable, NULL for rows to keep.

    Unusable content comes first; among the spam flags the strongest one wins (behaviour, links, repeated words,
    repeated characters). Behaviour is checked only where the columns exist.
    """
    minutes = F.col("playtime_at_review") if "playtime_at_review" in df.columns else F.lit(None).cast("double")
    n_reviews = F.col("num_reviews") if "num_reviews" in df.columns else F.lit(None).cast("int")
    return (
        F.when(text.is_blank(content), "null_or_empty")
        .when(text.is_punctuation_only(content), "punctuation_only")
        .when(text.is_non_english(content), "non_english")
        .when(text.is_behavioural_spam(minutes, n_reviews), "behavioral_spam")
        .when(text.has_many_links(content), "multiple_urls")
        .when(text.has_repetitive_words(content), "repetitive_words")
        .when(text.has_repeated_char(content), "repeated_char")
    )


def flag_rows(df: DataFrame, content: str = "review_content") -> DataFrame:
    """Keep every row and add exclude_reason and is_removed_cleaning (0/1)."""
    flagged = df.withColumn("exclude_reason", exclude_reason(df, content))
    return flagged.withColumn("is_removed_cleaning", F.col("exclude_reason").isNotNull().cast("int"))


def split_rows(df: DataFrame, content: str = "review_content") -> tuple[DataFrame, DataFrame]:
    """(kept rows, excluded rows with exclude_reason)."""
    flagged = df.withColumn("exclude_reason", exclude_reason(df, content))
    return flagged.where("exclude_reason IS NULL").drop("exclude_reason"), flagged.where("exclude_reason IS NOT NULL")


def reason_counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Excluded rows per reason ('kept' counts the rest)."""
    reason = F.coalesce(F.col("exclude_reason"), F.lit("kept")).alias("exclude_reason")
    return df.groupBy(*(by or []), reason).agg(F.count("*").alias("n_rows"))
