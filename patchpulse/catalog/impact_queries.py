"""Registered queries: windows, cleaning, statistics, signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows
from ..plans import impact
from . import sql as S
from . import views as V
from .registry import iso, query, r6

STAT_COLS = [f"{w}_{c}" for w in ("pre", "post") for c in ("mean", "positive", "neutral", "negative")]


def report(spark: SparkSession, sf_dir: str) -> impact.ImpactReport:
    return impact.impact_report(
        V.reviews(spark, sf_dir), V.updates(spark, sf_dir), V.comments(spark, sf_dir), V.announcements(spark, sf_dir),
        windows.patch_notes(V.news(spark, sf_dir)))


@query("R7", S.with_blocks(f"""
SELECT appid, update_id, pre_n, post_n, {', '.join(f'{S.s6(c)} AS {c}' for c in STAT_COLS)}, sentiment_delta,
       n_disagreements, gray_zone_count, w.cneg AS comment_negative, n_comments, overall_risk, n_signals
FROM with_comments w JOIN overall USING (appid, update_id)""", "with_comments", "overall"))
def impact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = report(spark, sf_dir).summary
    return s.select(
        "appid", "update_id", "pre_n", "post_n", *[r6(c).alias(c) for c in STAT_COLS], "sentiment_delta",
        "n_disagreements", "gray_zone_count", "comment_negative", "n_comments", "overall_risk", "n_signals",
    )


@query("R1-R5", S.with_blocks(
    "SELECT appid, update_id, rule, severity, severity_rank, value, threshold FROM signals", "signals"))
def risk_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir).signals.drop("description")
