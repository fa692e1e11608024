"""Second opinion on ambiguous reviews."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..operators import aggregates, comments, joins, risk, windows

KEYS = aggregates.UPDATE_KEYS


def relabel_gray(post: DataFrame, classify: Callable[[list[str]], list[str]], batch: int = config.TOPIC_BATCH,
                 rows: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Post-update reviews with the labels of the ambiguous ones replaced by ``classify``, which sees whole texts.

    Anything that is not a valid label counts as neutral. ``rows`` limits the rows per update to the oldest, ``max_chars`` the text.
    """
    gray = windows.gray_zone(post) if rows is None else windows.gray_queue(post, KEYS, rows)
    labelled = comments.apply_labeller(
        gray.select(*KEYS, "review_id", "review_content_processed"), "review_content_processed", "sentiment_label", classify,
        aggregates.LABELS, "neutral", batch, max_chars,
    )
    return joins.override_labels(post, labelled, [*KEYS, "review_id"])


def relabelled_signals(scored: DataFrame, updates: DataFrame, comment_stats: DataFrame | None,
                       classify: Callable[[list[str]], list[str]], **options) -> DataFrame:
    """Signals by stage: ``initial`` with the lexicon's labels, ``relabelled`` with statistics and delta computed anew."""
    post = relabel_gray(scored.where("window = 'post'"), classify, **options)
    parts = {"initial": scored, "relabelled": scored.where("window = 'pre'").unionByName(post)}
    out = None
    for stage, rows in parts.items():
        summary = risk.add_signals(aggregates.window_stats(rows, updates), comment_stats)
        fired = risk.risk_signals(summary).withColumn("stage", F.lit(stage))
        out = fired if out is None else out.unionByName(fired)
    return out
