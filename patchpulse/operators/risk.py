"""Risk signals per update and risk scores per review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text
from .aggregates import UPDATE_KEYS

CUTS = config.SignalThresholds()


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in config.SEVERITIES]), severity).cast("int")


def severity_name(rank: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(s) for s in config.SEVERITIES]), rank - 1), F.lit("LOW"))


def _signal(rule: str, fires: Column, severity: Column, value: Column, threshold: float, description: Column) -> Column:
    made = F.struct(
        F.lit(rule).alias("rule"),
        severity.alias("severity"),
        severity_rank(severity).alias("severity_rank"),
        value.alias("value"),
        F.lit(threshold).alias("threshold"),
        description.alias("description"),
    )
    return F.when(fires, made)


def add_signals(stats: DataFrame, comment_stats: DataFrame | None = None,
                cuts: config.SignalThresholds = CUTS, keys: list[str] = UPDATE_KEYS) -> DataFrame:
    """Add the fired rules R1-R5 as an array, their number and the overall risk (LOW when nothing fired).

    ``stats`` comes from ``window_stats``; ``comment_stats`` needs negative_pct and n_comments. R1-R3 and R5 need
    post-update reviews, R4 and R5 need comments. Signals are a projection of the statistics, not another pass.
    """
    if comment_stats is None:
        joined = stats.withColumns({
            "comment_negative": F.lit(None).cast("double"), "n_comments": F.lit(None).cast("bigint")
        })
    else:
        side = comment_stats.select(*keys, F.col("negative_pct").alias("comment_negative"), "n_comments")
        joined = stats.join(side, keys, "left")
    post, pre, delta = F.col("post_negative"), F.col("pre_negative"), F.col("sentiment_delta")
    has_reviews = F.col("post_n") > 0
    comm = F.col("comment_negative")
    volume = F.col("post_n") / F.col("pre_n")
    gap = F.abs(comm - post)
    all_signals = F.array(
        _signal(
            "R1", has_reviews & (delta > cuts.negative_rise),
            F.when(delta > cuts.negative_rise_critical, "CRITICAL")
            .when(delta > cuts.negative_rise_high, "HIGH").otherwise("MEDIUM"),
            delta, cuts.negative_rise,
            F.format_string("Negative review share rose by %s", text.percent(delta, 1)),
        ),
        _signal(
            "R2", has_reviews & (post > cuts.negative_share),
            F.when(post < cuts.negative_share_critical, "HIGH").otherwise("CRITICAL"),
            F.bround(post, 4), cuts.negative_share,
            F.format_string("%s of reviews after the update are negative", text.percent(post, 1)),
        ),
        _signal(
            "R3", has_reviews & (F.col("pre_n") > 0) & (F.col("post_n") > cuts.volume_factor * F.col("pre_n")),
            F.lit("MEDIUM"), F.bround(F.when(F.col("pre_n") > 0, volume), 2), cuts.volume_factor,
            F.format_string("Review volume is %.1f times the baseline", F.when(F.col("pre_n") > 0, volume)),
        ),
        _signal(
            "R4", comm > cuts.comment_negative,
            F.when(comm > cuts.comment_negative_critical, "CRITICAL").otherwise("HIGH"),
            F.bround(comm, 4), cuts.comment_negative,
            F.format_string("%s of %d announcement comments are negative", text.percent(comm, 1), F.col("n_comments")),
        ),
        _signal(
            "R5", has_reviews & (gap > cuts.divergence), F.lit("MEDIUM"), F.bround(gap, 4), cuts.divergence,
            F.format_string(
                "Comments (%s negative) and reviews (%s negative) differ by %s",
                text.percent(comm), text.percent(post), text.percent(gap),
            ),
        ),
    )
    out = joined.withColumn("signals", F.filter(all_signals, lambda s: s.isNotNull()))
    top = F.array_max(F.transform("signals", lambda s: s["severity_rank"]))
    return out.withColumns({
        "overall_risk": severity_name(F.coalesce(top, F.lit(1))), "n_signals": F.size("signals")
    })


def risk_signals(with_signals: DataFrame, keys: list[str] = UPDATE_KEYS) -> DataFrame:
    """One row per fired rule."""
    return with_signals.select(*keys, F.explode("signals").alias("s")).select(*keys, "s.*")


def overall_risk(signals: DataFrame, updates: DataFrame, keys: list[str] = UPDATE_KEYS) -> DataFrame:
    """Highest severity per update from a table of fired rules; LOW for updates without any."""
    top = signals.groupBy(*keys).agg(F.max("severity_rank").alias("_rank"), F.count("*").alias("n_signals"))
    return updates.select(*keys).join(top, keys, "left").select(
        *keys, severity_name(F.coalesce("_rank", F.lit(1))).alias("overall_risk"),
        F.coalesce("n_signals", F.lit(0)).alias("n_signals"),
    )


# ---------------------------------------------------------------------------------------------------------
# Row scores
# ---------------------------------------------------------------------------------------------------------


def risk_score(weights: config.RiskWeights = config.RiskWeights()) -> Column:
    """Weighted sum of the row flags; missing flags count as 0 and the sum is not clamped."""

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name).cast("int"), F.lit(0))

    negative = F.coalesce((F.col("compound") < weights.negative_cut).cast("int"), F.lit(0))
    total = (
        flag("is_toxic") * weights.toxic
        + negative * weights.strong_negative
        + flag("contains_bug_report") * weights.bug
        + flag("contains_balance_complaint") * weights.balance
        + flag("contains_monetization_complaint") * weights.monetization
        + flag("mentions_performance") * weights.performance
        + flag("controversial_sentiment") * weights.controversial
        + flag("recommendation_sentiment_mismatch") * weights.mismatch
        + (flag("negative_but_helpful") + flag("positive_but_unhelpful")) * weights.contradiction
    )
    return F.round(total, 4)


def risk_level(score: Column | str, cuts: config.LevelCuts) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return (
        F.when(s >= cuts.critical, "Critical").when(s >= cuts.high, "High").when(s >= cuts.medium, "Medium")
        .otherwise("Low")
    )


def add_risk(df: DataFrame, cuts: config.LevelCuts = config.FIXED_CUTS,
             weights: config.RiskWeights = config.RiskWeights()) -> DataFrame:
    """Add risk_score, risk_level and risk_label_weak."""
    scored = df.withColumn("risk_score", risk_score(weights))
    return scored.withColumns({
        "risk_level": risk_level("risk_score", cuts),
        "risk_label_weak": (F.col("risk_score") >= config.WEAK_LABEL_CUT).cast("int"),
    })


def derive_thresholds(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Level cuts per group by four methods: percentiles, mean and deviations, fixed, and the mixed one.

    Scores take few distinct values (sums of ten weights), so they are counted per value first; the percentiles
    are exact and no group is collected.
    """
    counted = scored.groupBy(*keys, "risk_score").agg(F.count("*").alias("_f"))
    q = F.percentile("risk_score", F.array(F.lit(0.75), F.lit(0.95), F.lit(0.99)), F.col("_f"))
    n = F.sum("_f")
    s1 = F.sum(F.col("risk_score") * F.col("_f"))
    s2 = F.sum(F.col("risk_score") * F.col("risk_score") * F.col("_f"))
    base = counted.groupBy(*keys).agg(n.alias("n"), q.alias("q"), (s1 / n).alias("mu"), s2.alias("s2"))
    var = (F.col("s2") - F.col("n") * F.col("mu") * F.col("mu")) / F.nullif(F.col("n") - 1, F.lit(0))
    return threshold_methods(base.withColumn("sd", F.coalesce(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(0.0))), keys)


def threshold_methods(base: DataFrame, keys: list[str]) -> DataFrame:
    """The four methods from q (the percentiles 75, 95 and 99), mu and sd of every group."""

    def half(x: Column) -> Column:
        return F.floor(x * 2 + F.lit(1e-9)) / 2

    mu, sd, p75, p95, p99 = F.col("mu"), F.col("sd"), F.col("q")[0], F.col("q")[1], F.col("q")[2]
    def row(name: str, critical: Column, high: Column, medium: Column) -> Column:
        return F.struct(
            F.lit(name).alias("method"), critical.cast("double").alias("critical"), high.cast("double").alias("high"),
            medium.cast("double").alias("medium"),
        )

    fixed = config.FIXED_CUTS
    methods = F.array(
        row("percentile", p99, p95, p75),
        row("deviation", mu + 2 * sd, mu + sd, mu),
        row("fixed", F.lit(fixed.critical), F.lit(fixed.high), F.lit(fixed.medium)),
        row("mixed", half((p99 + mu + 2 * sd) / 2), half((p95 + mu + sd) / 2), half((p75 + mu) / 2)),
    )
    return base.select(*keys, F.explode(methods).alias("m")).select(*keys, "m.*")


def level_transitions(scored: DataFrame, first: config.LevelCuts = config.FIXED_CUTS,
                      second: config.LevelCuts = config.MIXED_CUTS) -> DataFrame:
    """Rows per pair of levels under two sets of cuts; ``is_boundary`` marks Critical that became High."""
    a, b = risk_level("risk_score", first).alias("level_a"), risk_level("risk_score", second).alias("level_b")
    return scored.groupBy(a, b).agg(F.count("*").alias("n_rows")).withColumn(
        "is_boundary", (F.col("level_a") == "Critical") & (F.col("level_b") == "High")
    )


def score_distribution(scored: DataFrame) -> DataFrame:
    """Mean, median, std and percentiles of the score overall and per weak label, from per-value counts."""
    counted = scored.groupBy("risk_label_weak", "risk_score").agg(F.count("*").alias("_f"))
    both = counted.withColumn("scope", F.explode(F.array(F.lit("all"), F.concat(F.lit("label_"), "risk_label_weak"))))
    n = F.sum("_f")
    mean = F.sum(F.col("risk_score") * F.col("_f")) / n
    square = F.sum(F.col("risk_score") * F.col("risk_score") * F.col("_f"))
    q = F.percentile("risk_score", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)]), F.col("_f"))
    out = both.groupBy("scope").agg(
        n.alias("n_rows"), mean.alias("mean"), square.alias("_sq"), q.alias("q"), F.max("risk_score").alias("max")
    )
    var = (F.col("_sq") - F.col("n_rows") * F.col("mean") * F.col("mean")) / F.nullif(F.col("n_rows") - 1, F.lit(0))
    return out.select(
        "scope", "n_rows", "mean", F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"), "max",
        *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75, 90, 95, 99))],
    )


def cumulative_share(scored: DataFrame) -> DataFrame:
    """Share of rows at or below every score value (the cumulative curve)."""
    from pyspark.sql.window import Window

    counted = scored.groupBy("risk_score").agg(F.count("*").alias("n_rows"))
    # One row per distinct score (at most a few hundred), so a single running sum is safe.
    w = Window.orderBy("risk_score")
    total = F.sum("n_rows").over(Window.partitionBy())
    return counted.select("risk_score", "n_rows", (F.sum("n_rows").over(w) / total).alias("cumulative_share"))
