"""Monitoring after an update: hourly figures, comparison with the baseline, alerts, detection of updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import features, text
from ..operators import aggregates, anomaly, risk, timeline, windows
from ..session import broadcast_if_small, materialise

KEYS = aggregates.UPDATE_KEYS


def score_rows(reviews: DataFrame, lexicon: DataFrame | None = None,
               cuts: config.LevelCuts = config.FIXED_CUTS) -> DataFrame:
    """Sentiment, topic, flags, risk score and level of every review."""
    scored = features.add_risk_features(features.add_text_features(reviews, lexicon=lexicon))
    scored = scored.withColumn("topic", text.keyword_topic("review_content_processed"))
    return risk.add_risk(scored, cuts)


def add_trend_alerts(scored: DataFrame, row_id: str = "doc_id", contamination: float = 0.05) -> DataFrame:
    """Rolling trends, statistical and model anomalies and the trend alert, joined back to the scored rows.

    Only ids, times and numbers travel through the trend plan; texts are joined back at the end.
    """
    slim = scored.select("appid", row_id, "ts", "compound", "votes_up", F.length("review_content_processed").alias(
        "text_length"), F.col("topic").alias("dominant_topic"))
    slim = materialise(slim)
    rolled = timeline.rolling_features(slim, score="compound", row_id=row_id)
    trends = timeline.trend_features(rolled, row_id=row_id)
    joined = timeline.add_hourly_count(slim).join(trends, ["appid", row_id])
    flagged = anomaly.detect_statistical(joined, ["appid"])
    model = anomaly.detect_elliptic(
        flagged, ["compound", "sentiment_rolling_std_24h", "sentiment_diff_24h", "text_length", "comment_rate_24h",
                  "neg_ratio_rolling_24h", "sentiment_volatility"], contamination)
    alerts = anomaly.trend_alerts(anomaly.detect_combined(model))
    keep = ("statistical_anomaly_score", "is_statistical_anomaly", "ml_anomaly", "ensemble_anomaly_score",
            "anomaly_severity", "trigger_count", "trend_alert")
    return scored.join(alerts.select("appid", row_id, *keep), ["appid", row_id], "left")


def with_settings(updates: DataFrame, hours: int = 48, baseline_days: int = 7) -> DataFrame:
    """Updates that are monitored, each with its window_hours and baseline_days; where it has none, the given ones hold.

    Updates with ``enabled`` false are left out.
    """
    own = updates.columns
    on = updates.where(F.coalesce("enabled", F.lit(True))) if "enabled" in own else updates
    defaults = {"window_hours": hours, "baseline_days": baseline_days}
    return on.withColumns({
        c: F.coalesce(F.col(c).cast("int"), F.lit(d)) if c in own else F.lit(d) for c, d in defaults.items()
    })


def in_window(scored: DataFrame, updates: DataFrame, hours: int = 48, baseline_days: int = 7) -> DataFrame:
    """Rows of the monitoring window [U, U + hours) and of the baseline [U - days, U), tagged 'monitor'/'baseline'.

    Updates may carry window_hours, baseline_days and enabled of their own.
    """
    at = F.date_trunc("second", "update_ts")
    u = with_settings(updates, hours, baseline_days).select(
        "appid", "update_id", at.alias("update_ts"), (at - F.make_dt_interval(F.col("baseline_days"))).alias("_start"),
        (at + F.make_dt_interval(F.lit(0), F.col("window_hours"))).alias("_end"),
    )
    u = u.select("*", F.explode(F.sequence(F.to_date("_start"), F.to_date("_end"))).alias("_day"))
    joined = scored.withColumn("_day", F.to_date("ts")).join(broadcast_if_small(u), ["appid", "_day"])
    ts = F.col("ts")
    return joined.where((ts >= F.col("_start")) & (ts < F.col("_end"))).withColumn(
        "window", F.when(ts >= F.col("update_ts"), "monitor").otherwise("baseline")
    ).drop("_day", "_start", "_end")


def _measures() -> list[Column]:
    high = F.col("risk_level").isin("Critical", "High")
    return [
        F.count("*").alias("n_reviews"),
        *[F.count_if(F.col("sentiment_label") == v).alias(f"n_{v}") for v in aggregates.LABELS],
        F.avg("risk_score").alias("mean_risk"),
        F.max("risk_score").alias("max_risk"),
        F.count_if(high).alias("n_high_risk"),
    ]


def hourly_monitor(tagged: DataFrame) -> DataFrame:
    """Figures per hour of the monitoring window and, in the same pass, the total row (hour NULL)."""
    rows = tagged.where("window = 'monitor'").withColumn("hour", F.date_trunc("hour", "ts"))
    sets = [[F.col(k) for k in KEYS] + [F.col("hour")], [F.col(k) for k in KEYS]]
    out = rows.groupingSets(sets, *KEYS, "hour").agg(*_measures())
    n = F.col("n_reviews")
    return out.withColumns({"negative_share": F.col("n_negative") / n, "high_risk_share": F.col("n_high_risk") / n})


def topic_share(tagged: DataFrame) -> DataFrame:
    return aggregates.topic_counts(tagged.where("window = 'monitor'"), KEYS)


def baseline_compare(tagged: DataFrame, hours: int = 48, baseline_days: int = 7, flag_change: float = 0.5) -> DataFrame:
    """Per-hour rate, negative share, mean risk and high-risk share against the baseline; big changes are flagged."""
    span = {"baseline": baseline_days * 24.0, "monitor": float(hours)}

    def pair(w: str) -> list[Column]:
        inside = F.col("window") == w
        n = F.nullif(F.count_if(inside), F.lit(0))
        high = F.col("risk_level").isin("Critical", "High")
        return [
            (F.count_if(inside) / span[w]).alias(f"{w}_rate_per_hour"),
            (F.count_if(inside & (F.col("sentiment_label") == "negative")) / n).alias(f"{w}_negative_share"),
            F.avg(F.when(inside, F.col("risk_score"))).alias(f"{w}_mean_risk"),
            (F.count_if(inside & high) / n).alias(f"{w}_high_risk_share"),
        ]

    wide = tagged.groupBy(*KEYS).agg(*pair("baseline"), *pair("monitor"))
    names = ("rate_per_hour", "negative_share", "mean_risk", "high_risk_share")
    rows = F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(f"baseline_{n}").alias("baseline"), F.col(f"monitor_{n}").alias("monitor"))
        for n in names
    ])
    out = wide.select(*KEYS, F.explode(rows).alias("r")).select(*KEYS, "r.*")
    change = (F.col("monitor") - F.col("baseline")) / F.nullif(F.col("baseline"), F.lit(0.0))
    out = out.withColumn("change", change)
    return out.withColumn("is_significant", F.coalesce(F.abs("change") > flag_change, F.lit(False)))


def crisis_alerts(tagged: DataFrame, updates: DataFrame, hours: int = 48, baseline_days: int = 7,
                  cuts: config.CrisisThresholds = config.CrisisThresholds()) -> DataFrame:
    """One row per fired alert. Updates may carry their own negative_sentiment_pct, critical_risk_pct, window_hours,
    baseline_days and enabled."""
    updates = with_settings(updates, hours, baseline_days)
    own = {c: c for c in ("negative_sentiment_pct", "critical_risk_pct") if c in updates.columns}
    cut_cols = {
        c: (F.coalesce(F.col(c), F.lit(getattr(cuts, c))) if c in own else F.lit(getattr(cuts, c)))
        for c in ("negative_sentiment_pct", "critical_risk_pct")
    }
    u = updates.select(*KEYS, "window_hours", "baseline_days", *[v.alias(f"_{c}") for c, v in cut_cols.items()])
    mon = F.col("window") == "monitor"
    high = F.col("risk_level").isin("Critical", "High")
    negative = F.col("sentiment_label") == "negative"
    trend = F.col("trend_alert") == 1 if "trend_alert" in tagged.columns else F.lit(False)
    stats = tagged.groupBy(*KEYS).agg(
        F.count_if(mon).alias("n"),
        F.count_if(~mon).alias("n_base"),
        F.count_if(mon & negative).alias("n_neg"),
        F.count_if(mon & (F.col("risk_level") == "Critical")).alias("n_crit"),
        F.count_if(mon & negative & (F.col("topic") == "monetization")).alias("n_money"),
        F.count_if(mon & high & trend).alias("n_both"),
    )
    joined = u.join(stats, KEYS)
    n = F.nullif(F.col("n"), F.lit(0))
    base_rate = F.col("n_base") / (F.col("baseline_days") * 24.0)
    rate = F.col("n") / F.col("window_hours").cast("double")

    def alert(rule: str, severity: str, value: Column, threshold: Column, fires: Column) -> Column:
        made = F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), value.alias("value"),
                        threshold.alias("threshold"))
        return F.when(fires, made)

    neg, crit, money = F.col("n_neg") / n, F.col("n_crit") / n, F.col("n_money") / n
    times = rate / F.nullif(base_rate, F.lit(0.0))
    cut_neg, cut_crit = F.col("_negative_sentiment_pct"), F.col("_critical_risk_pct")
    fired = F.filter(F.array(
        alert("negative_surge", "HIGH", neg, cut_neg, neg > cut_neg),
        alert("critical_share", "CRITICAL", crit, cut_crit, crit > cut_crit),
        alert("monetization_dispute", "MEDIUM", money, F.lit(cuts.monetization_negative_pct),
              money > cuts.monetization_negative_pct),
        alert("volume", "MEDIUM", times, F.lit(cuts.volume_factor), times > cuts.volume_factor),
        alert("combined", "CRITICAL", F.col("n_both").cast("double"), F.lit(float(cuts.combined_rows)),
              F.col("n_both") >= cuts.combined_rows),
    ), lambda a: a.isNotNull())
    return joined.select(*KEYS, F.explode(fired).alias("a")).select(*KEYS, "a.*")


def detect_updates(reviews: DataFrame, sigma: float = 2.5, keywords: tuple[str, ...] = ("update", "patch"),
                   content: str = "review_content") -> DataFrame:
    """Hours whose volume is far above the app's mean and in which some review names an update."""
    hourly = reviews.groupBy("appid", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.count("*").alias("n_reviews"),
        F.sum(text.mentions(content, keywords)).alias("n_keyword"),
    )
    stats = hourly.groupBy("appid").agg(F.avg("n_reviews").alias("_m"), F.stddev_samp("n_reviews").alias("_s"))
    jump = F.col("n_reviews") > F.col("_m") + sigma * F.col("_s")
    return hourly.join(stats, "appid").where(jump & (F.col("n_keyword") > 0)).drop("_m", "_s")


def score_window(reviews: DataFrame, start: str, hours: int = 48, lexicon: DataFrame | None = None) -> DataFrame:
    """Every review of [start, start + hours) with sentiment, topic, risk and trend alert.

    Trends need history, so the rows of the widest rolling window before ``start`` are read too.
    """
    begin = F.lit(start).cast("timestamp")
    reach = F.make_dt_interval(F.lit(0), F.lit(max(config.ROLLING_HOURS)))
    end = begin + F.make_dt_interval(F.lit(0), F.lit(hours))
    near = reviews.where((F.col("ts") >= begin - reach) & (F.col("ts") < end))
    out = add_trend_alerts(score_rows(near, lexicon))
    return out.where((F.col("ts") >= begin) & (F.col("ts") < end))


def window_summary(scored: DataFrame) -> DataFrame:
    """Summary of a scored window per app."""
    return scored.groupBy("appid").agg(*_measures(), F.sum("trend_alert").alias("n_trend_alerts"))


__all__ = [
    "add_trend_alerts", "baseline_compare", "crisis_alerts", "detect_updates", "hourly_monitor", "in_window",
    "score_rows", "score_window", "topic_share", "window_summary", "windows",
]
