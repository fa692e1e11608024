"""The whole update-impact report as one plan over many apps and updates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import features, text
from ..operators import aggregates, cleaning, comments as comment_ops, joins, risk, windows

KEYS = aggregates.UPDATE_KEYS


@dataclass(frozen=True)
class ImpactReport:
    """The parts of the report; each is keyed by (appid, update_id)."""

    summary: DataFrame
    signals: DataFrame
    topics: DataFrame
    comments: DataFrame | None


def scored_windows(reviews: DataFrame, updates: DataFrame, clean_post: bool = True, clean_pre: bool = False,
                   lexicon: DataFrame | None = None) -> DataFrame:
    """Reviews inside update windows, unusable ones dropped, with sentiment.

    By default only reviews after the update are cleaned; the baseline keeps every row.
    """
    tagged = windows.split_windows(reviews, updates)
    cleaned: Column | None = None
    if clean_post and clean_pre:
        cleaned = F.lit(True)
    elif clean_post:
        cleaned = F.col("window") == "post"
    elif clean_pre:
        cleaned = F.col("window") == "pre"
    if cleaned is not None:
        tagged = tagged.where(~cleaned | cleaning.exclude_reason(tagged).isNull())
    return features.add_text_features(tagged, lexicon=lexicon)


def update_comments(comments: DataFrame, sources: DataFrame) -> DataFrame:
    """Comment statistics per update, of the comments under the topic chosen for it (native labels, pre-filtered)."""
    kept = comment_ops.prefilter(joins.comments_of_updates(comments, sources), KEYS)
    return comment_ops.label_stats(comment_ops.label_comments(kept), KEYS)


def impact_report(reviews: DataFrame, updates: DataFrame, comments: DataFrame | None = None,
                  events: DataFrame | None = None, notes: DataFrame | None = None, clean_pre: bool = False, thresholds: config.SignalThresholds = config.SignalThresholds(),
                  lexicon: DataFrame | None = None) -> ImpactReport:
    """Windows, cleaning, sentiment, topics, comments, signals and overall risk for all updates.

    ``comments`` are taken from the topic of each update's nearest announcement in ``events``, else of its nearest patch note in
    ``notes``; an update without either has none.
    """
    scored = scored_windows(reviews, updates, clean_pre=clean_pre, lexicon=lexicon)
    comm = None
    if comments is not None:
        if events is None or notes is None:
            raise ValueError("comments need events and notes, which tell the updates they belong to")
        comm = update_comments(comments, joins.nearest_comment_source(updates, events, notes, comments))
    summary = risk.add_signals(aggregates.window_stats(scored, updates, extra=post_counts()), comm, thresholds)
    topics = aggregates.topic_counts(
        scored.where("window = 'post'").withColumn("topic", text.keyword_topic("review_content_processed")), KEYS
    )
    return ImpactReport(summary, risk.risk_signals(summary), topics, comm)


def post_counts() -> list[Column]:
    """Contradicting and ambiguous rows after the update."""
    post = F.col("window") == "post"
    return [
        F.count_if(post & windows.disagrees()).alias("n_disagreements"),
        F.count_if(post & F.col("compound").between(-config.LABEL_CUT, config.LABEL_CUT)).alias("gray_zone_count"),
    ]
