"""Many known updates checked against expectations in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..operators import aggregates, risk
from . import impact

KEYS = aggregates.UPDATE_KEYS


def backtest(reviews: DataFrame, cases: DataFrame, min_rows: int = config.MIN_WINDOW_ROWS,
             lexicon: DataFrame | None = None) -> DataFrame:
    """One row per case: window sizes, negative shares, risk and whether both expectations hold.

    ``cases``: appid, update_id, update_ts, pre_days, post_days, expected_risk array<string>, expected_delta
    ('-' worse, '+' better, '?' either). Nothing is cleaned and comments are not used. Cases with too few rows on
    either side have no verdict.
    """
    tagged = impact.scored_windows(reviews, cases, clean_post=False, lexicon=lexicon)
    stats = risk.add_signals(aggregates.window_stats(tagged, cases))
    joined = cases.select(*KEYS, "expected_risk", "expected_delta").join(stats, KEYS)
    ok = (F.col("pre_n") >= min_rows) & (F.col("post_n") >= min_rows)
    delta = F.col("neg_delta")
    sign_ok = (
        F.when(F.col("expected_delta") == "-", delta > 0).when(F.col("expected_delta") == "+", delta < 0)
        .otherwise(F.lit(True))
    )
    out = joined.withColumn("neg_delta", F.bround(F.col("post_negative") - F.col("pre_negative"), 4) + 0.0)
    out = out.withColumns({
        "data_ok": ok,
        "pass_risk": F.when(ok, F.array_contains("expected_risk", F.col("overall_risk"))),
        "pass_delta": F.when(ok, sign_ok),
    })
    return out.select(
        *KEYS, "pre_n", "post_n", "pre_negative", "post_negative", "neg_delta", "overall_risk", "n_signals", "data_ok",
        "pass_risk", "pass_delta", (F.col("pass_risk") & F.col("pass_delta")).alias("passed"),
    )


def backtest_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("n_total"), F.count_if("data_ok").alias("n_ran"), F.count_if("passed").alias("n_passed"),
        F.count_if(~F.col("data_ok")).alias("n_skipped"),
    )
