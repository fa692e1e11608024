"""Registered queries: row risk, monitoring, alerts, anomalies, backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anomaly, changes, coordinated, risk, summaries, timeline, windows
from ..plans import backtest as bt
from ..plans import monitor
from ..session import fresh_path, save_table
from ..sources import sinks
from . import sql as S
from . import views as V
from .registry import REGISTRY, iso, query, r6
from .review_queries import KEYS, scored_reviews

LABELS = ("positive", "neutral", "negative")


def risk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.score_rows(V.reviews(spark, sf_dir))


@query("R9, R10", S.with_blocks(
    f"SELECT review_id, risk_score, risk_level, {S.level('risk_score', 3.0, 2.0, 1.0)} AS risk_level_mixed, risk_label_weak "
    "FROM levelled", "levelled"))
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .. import config

    return risk_rows(spark, sf_dir).select(
        "review_id", "risk_score", "risk_level",
        risk.risk_level("risk_score", config.MIXED_CUTS).alias("risk_level_mixed"), "risk_label_weak")


S.block("cuts_base", """
SELECT appid, quantile_cont(risk_score, [0.75, 0.95, 0.99]) AS q, avg(risk_score) AS mu,
       coalesce(stddev_samp(risk_score), 0) AS sd FROM risk_rows GROUP BY appid""", "risk_rows")


@query("R11", S.with_blocks(f"""
SELECT appid, method, {S.s6('critical')} AS critical, {S.s6('high')} AS high, {S.s6('medium')} AS medium FROM (
  SELECT appid, 'percentile' AS method, q[3] AS critical, q[2] AS high, q[1] AS medium FROM cuts_base
  UNION ALL SELECT appid, 'deviation', mu + 2 * sd, mu + sd, mu FROM cuts_base
  UNION ALL SELECT appid, 'fixed', 2.5, 1.5, 1.0 FROM cuts_base
  UNION ALL SELECT appid, 'mixed', floor((q[3] + mu + 2 * sd) + 1e-9) / 2, floor((q[2] + mu + sd) + 1e-9) / 2,
                   floor((q[1] + mu) + 1e-9) / 2 FROM cuts_base)""", "cuts_base"))
def risk_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = risk.derive_thresholds(risk_rows(spark, sf_dir), ["appid"])
    return out.select("appid", "method", *[r6(c).alias(c) for c in ("critical", "high", "medium")])


@query("G15, R11")
def summary_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level cuts of every app and week from stored hourly summaries, within the stated rank error."""
    rows = risk_rows(spark, sf_dir)
    stored = save_table(summaries.hourly_summaries(rows, "risk_score", "author_id"), "hourly-summaries")
    weekly = stored.withColumn("week", iso(F.date_trunc("week", "hour")))
    return summaries.window_thresholds(weekly, ["appid", "week"])


@query("R12", S.with_blocks(f"""
SELECT level_a, level_b, count(*) AS n_rows, level_a = 'Critical' AND level_b = 'High' AS is_boundary FROM (
  SELECT risk_level AS level_a, {S.level('risk_score', 3.0, 2.0, 1.0)} AS level_b FROM levelled) GROUP BY ALL""", "levelled"))
def level_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.level_transitions(risk_rows(spark, sf_dir))


_PCT = ((25, 0.25), (50, 0.5), (75, 0.75), (90, 0.9), (95, 0.95), (99, 0.99))


@query("G15", S.with_blocks(f"""
SELECT scope, count(*) AS n_rows, {S.s6('avg(risk_score)')} AS mean, {S.s6('coalesce(stddev_samp(risk_score), 0)')} AS std,
       max(risk_score) AS max, {', '.join(f"{S.s6(f'quantile_cont(risk_score, {p})')} AS p{n}" for n, p in _PCT)}
FROM (SELECT 'all' AS scope, risk_score FROM levelled
      UNION ALL SELECT 'label_' || risk_label_weak, risk_score FROM levelled) GROUP BY scope""", "levelled"))
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = risk.score_distribution(risk_rows(spark, sf_dir))
    return out.select("scope", "n_rows", r6("mean").alias("mean"), r6("std").alias("std"), "max",
                      *[r6(f"p{n}").alias(f"p{n}") for n, _ in _PCT])


@query("G15", S.with_blocks(f"""
SELECT risk_score, n_rows, {S.s6('sum(n_rows) OVER (ORDER BY risk_score) / sum(n_rows) OVER ()')} AS cumulative_share
FROM (SELECT risk_score, count(*) AS n_rows FROM risk_rows GROUP BY risk_score)""", "risk_rows"))
def cumulative_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = risk.cumulative_share(risk_rows(spark, sf_dir))
    return out.select("risk_score", "n_rows", r6("cumulative_share").alias("cumulative_share"))


@query("K3", S.with_blocks(
    "SELECT review_id, risk_score FROM risk_rows ORDER BY risk_score DESC, review_id LIMIT 1000", "risk_rows"))
def top_risk_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.top_rows(risk_rows(spark, sf_dir).select("review_id", "risk_score"), 1000)


S.block("monitored", """
SELECT r.*, u.update_id, CASE WHEN r.ts >= u.update_ts THEN 'monitor' ELSE 'baseline' END AS "window"
FROM levelled r JOIN updates_v u ON u.appid = r.appid
 AND r.ts >= u.update_ts - INTERVAL 7 DAY AND r.ts < u.update_ts + INTERVAL 48 HOUR""", "levelled", "updates_v")


@query("K3", S.with_blocks("""
SELECT appid, update_id, review_id, risk_score, CAST(k AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY appid, update_id ORDER BY risk_score DESC, review_id) AS k FROM monitored
  WHERE "window" = 'monitor') WHERE k <= 20""", "monitored"))
def top_monitored(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = monitored(spark, sf_dir).where("window = 'monitor'")
    out = windows.top_per_group(tagged, KEYS, 20, [F.desc("risk_score"), F.asc("review_id")])
    return out.select(*KEYS, "review_id", "risk_score", "rank")


def monitored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.in_window(risk_rows(spark, sf_dir), V.updates(spark, sf_dir))


@query("G13", S.with_blocks(f"""
SELECT appid, update_id, {S.iso("date_trunc('hour', ts)")} AS hour, count(*) AS n_reviews,
       {', '.join(f"count(*) FILTER (sentiment_label = '{v}') AS n_{v}" for v in LABELS)},
       {S.s6('avg(risk_score)')} AS mean_risk, max(risk_score) AS max_risk,
       count(*) FILTER (risk_level IN ('Critical', 'High')) AS n_high_risk,
       {S.s6("count(*) FILTER (sentiment_label = 'negative') / count(*)")} AS negative_share,
       {S.s6("count(*) FILTER (risk_level IN ('Critical', 'High')) / count(*)")} AS high_risk_share
FROM monitored WHERE "window" = 'monitor'
GROUP BY GROUPING SETS ((appid, update_id, date_trunc('hour', ts)), (appid, update_id))""", "monitored"))
def hourly_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = monitor.hourly_monitor(monitored(spark, sf_dir))
    return out.select(*KEYS, iso("hour").alias("hour"), "n_reviews", *[f"n_{v}" for v in LABELS],
                      r6("mean_risk").alias("mean_risk"), "max_risk", "n_high_risk",
                      r6("negative_share").alias("negative_share"), r6("high_risk_share").alias("high_risk_share"))


@query("G13", S.with_blocks(f"""
SELECT appid, update_id, label, count(*) AS "count",
       round_even(count(*) / sum(count(*)) OVER (PARTITION BY appid, update_id), 4) AS pct
FROM (SELECT *, {S.topic_case('processed')} AS label FROM monitored WHERE "window" = 'monitor') GROUP BY appid, update_id, label""",
    "monitored"))
def monitor_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.topic_share(monitored(spark, sf_dir))


def _cmp(metric: str, base: str, mon: str) -> str:
    return f"SELECT appid, update_id, '{metric}' AS metric, {base} AS baseline, {mon} AS monitor FROM monitored GROUP BY ALL"


def _both(expr: str) -> tuple[str, str]:
    return expr.format(w="baseline"), expr.format(w="monitor")


_F = "count(*) FILTER (\"window\" = '{w}')"
S.block("compared", " UNION ALL ".join([
    _cmp("rate_per_hour", f"{_both(_F)[0]} / 168.0::DOUBLE", f"{_both(_F)[1]} / 48.0::DOUBLE"),
    _cmp("negative_share", *_both(
        "count(*) FILTER (\"window\" = '{w}' AND sentiment_label = 'negative') / nullif(" + _F + ", 0)")),
    _cmp("mean_risk", *_both("avg(risk_score) FILTER (\"window\" = '{w}')")),
    _cmp("high_risk_share", *_both(
        "count(*) FILTER (\"window\" = '{w}' AND risk_level IN ('Critical', 'High')) / nullif(" + _F + ", 0)")),
]), "monitored")


@query("G14", S.with_blocks(f"""
SELECT appid, update_id, metric, {S.s6('baseline')} AS baseline, {S.s6('monitor')} AS monitor,
       {S.s6('(monitor - baseline) / nullif(baseline, 0)')} AS change,
       coalesce(abs((monitor - baseline) / nullif(baseline, 0)) > 0.5, false) AS is_significant FROM compared""", "compared"))
def baseline_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = monitor.baseline_compare(monitored(spark, sf_dir))
    return out.select(*KEYS, "metric", *[r6(c).alias(c) for c in ("baseline", "monitor", "change")], "is_significant")


# Rolling trends of reviews.
def _review_frames() -> str:
    return "WINDOW " + ", ".join(
        f"w{w} AS (PARTITION BY appid ORDER BY epoch_us(ts) RANGE BETWEEN {w * 3600000000 - 1} PRECEDING AND CURRENT ROW)"
        for w in (24, 48, 72))


_c = ", ".join(
    f"avg(compound) OVER w{w} AS m{w}, count(*) OVER w{w} AS r{w}, stddev_samp(compound) OVER w{w} AS s{w}"
    for w in (24, 48, 72))
S.block("rev_roll", f"SELECT doc_id, {_c} FROM rev_s {_review_frames()}", "rev_s")
_d = ", ".join(
    f"m{w} - lag(m{w}) OVER o AS sentiment_diff_{w}h, (r{w} - lag(r{w}) OVER o) / nullif(lag(r{w}) OVER o, 0) AS comment_rate_change_{w}h"
    for w in (24, 48, 72))
S.block("rev_trend", f"""
SELECT *, {_d}, count(*) OVER (PARTITION BY appid, date_trunc('hour', ts)) AS hourly_count
FROM levelled JOIN rev_roll USING (doc_id) WINDOW o AS (PARTITION BY appid ORDER BY ts, doc_id)""", "levelled", "rev_roll")
S.block("rev_stat", f"""
SELECT *, is_sentiment_anomaly + is_volume_anomaly + is_vote_anomaly + is_trend_anomaly AS statistical_anomaly_score FROM (
  SELECT *, coalesce(CAST(abs(compound - avg(compound) OVER a) > 2.5 * stddev_samp(compound) OVER a AS INT), 0) AS is_sentiment_anomaly,
    coalesce(CAST(hourly_count - avg(hourly_count) OVER a > 2.5 * stddev_samp(hourly_count) OVER a AS INT), 0) AS is_volume_anomaly,
    coalesce(CAST(vpc - avg(vpc) OVER a > 2.5 * stddev_samp(vpc) OVER a AS INT), 0) AS is_vote_anomaly,
    coalesce(CAST(abs(sentiment_diff_24h - avg(sentiment_diff_24h) OVER a) > 2.5 * stddev_samp(sentiment_diff_24h) OVER a AS INT), 0)
      AS is_trend_anomaly,
    coalesce(CAST(count(*) OVER (PARTITION BY appid, topic) / count(*) OVER a < 0.05 AS INT), 0) AS is_rare_topic
  FROM (SELECT *, votes_up / (length(processed) + 1) AS vpc, {S.topic_case('processed')} AS topic FROM rev_trend)
  WINDOW a AS (PARTITION BY appid))""", "rev_trend")


def trend_rows(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Scored reviews with rolling trends, numbers only."""
    scored = (risk_rows(spark, sf_dir).withColumn("text_length", F.length("review_content_processed"))
              if rows is None else rows).select(
        "appid", "doc_id", "ts", "compound", "votes_up", "text_length",
        F.col("topic").alias("dominant_topic"), "risk_label_weak")
    scored = save_table(scored, "scored") if rows is None else scored
    rolled = timeline.rolling_features(scored, score="compound", row_id="doc_id")
    trends = timeline.trend_features(rolled, row_id="doc_id")
    return timeline.add_hourly_count(scored).join(trends, ["appid", "doc_id"])


@query("A1", S.with_blocks("""
SELECT doc_id, hourly_count, is_sentiment_anomaly, is_volume_anomaly, is_vote_anomaly, is_trend_anomaly, is_rare_topic,
       statistical_anomaly_score, CAST(statistical_anomaly_score >= 2 AS INT) AS is_statistical_anomaly FROM rev_stat""", "rev_stat"))
def statistical_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = anomaly.detect_statistical(trend_rows(spark, sf_dir), ["appid"])
    return out.select("doc_id", "hourly_count", "is_sentiment_anomaly", "is_volume_anomaly", "is_vote_anomaly",
                      "is_trend_anomaly", "is_rare_topic", "statistical_anomaly_score", "is_statistical_anomaly")


def mahalanobis(name: str, source: str, features: tuple[str, str, str]) -> None:
    """Block ``name``: the rows of ``source`` with ``ml``, the squared distance from the closed inverse of a 3 x 3 correlation."""
    S.block(f"{name}_z", "SELECT *, " + ", ".join(
        f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z{i}" for i, c in enumerate(features, 1)) + f" FROM {source}", source)
    S.block(f"{name}_r", f"SELECT avg(z1 * z2) AS a, avg(z1 * z3) AS b, avg(z2 * z3) AS c FROM {name}_z", f"{name}_z")
    S.block(name, f"""
SELECT *, ((1 - c * c) * z1 * z1 + (1 - b * b) * z2 * z2 + (1 - a * a) * z3 * z3 + 2 * ((b * c - a) * z1 * z2
          + (a * c - b) * z1 * z3 + (a * b - c) * z2 * z3)) / (1 + 2 * a * b * c - a * a - b * b - c * c) AS ml
FROM {name}_z, {name}_r""", f"{name}_z", f"{name}_r")


REVIEW_FEATURES = ("compound", "votes_up", "text_length")
S.block("rev_long", "SELECT *, length(processed) AS text_length FROM rev_stat", "rev_stat")
mahalanobis("rev_ml", "rev_long", REVIEW_FEATURES)
S.block("rev_ens", """
SELECT *, (ml - min(ml) OVER ()) / (max(ml) OVER () - min(ml) OVER ()) * 0.6::DOUBLE
       + CASE WHEN max(statistical_anomaly_score) OVER () > min(statistical_anomaly_score) OVER () THEN
         (statistical_anomaly_score - min(statistical_anomaly_score) OVER ()) / (max(statistical_anomaly_score) OVER () - min(statistical_anomaly_score) OVER ())
         ELSE 0 END * 0.4::DOUBLE AS ens,
       CAST(ml > (SELECT quantile_cont(ml, 0.95) FROM rev_ml) AS INT) AS ml_anomaly FROM rev_ml""", "rev_ml")
S.block("rev_sev", """
SELECT *, (ens - min(ens) OVER ()) / (max(ens) OVER () - min(ens) OVER ()) AS sev FROM rev_ens""", "rev_ens")


def ensemble_rows(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    flagged = anomaly.detect_statistical(trend_rows(spark, sf_dir, rows), ["appid"])
    return anomaly.detect_combined(anomaly.detect_elliptic(flagged, list(REVIEW_FEATURES)))


@query("A3", S.with_blocks(f"""
SELECT doc_id, {S.s6('ens')} AS ensemble_anomaly_score, {S.s6('sev')} AS anomaly_severity_score,
       CASE WHEN sev + 1e-12 >= q[2] THEN 'high' WHEN sev + 1e-12 >= q[1] THEN 'medium' ELSE 'low' END AS anomaly_severity
FROM rev_sev, (SELECT quantile_cont(sev, [0.8, 0.95]) AS q FROM rev_sev)""", "rev_sev"))
def combined_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ensemble_rows(spark, sf_dir)
    return out.select("doc_id", r6("ensemble_anomaly_score").alias("ensemble_anomaly_score"),
                      r6("anomaly_severity_score").alias("anomaly_severity_score"), "anomaly_severity")


_meas = ["ens"] + [f"abs({p}_{w}h)" for w in (24, 48, 72) for p in ("sentiment_diff", "comment_rate_change")]
S.block("rev_alert", f"""
SELECT doc_id, appid, risk_label_weak, statistical_anomaly_score, ml_anomaly,
       {' + '.join(f'coalesce(CAST({m} + 1e-12 >= (SELECT quantile_cont({m}, 0.95) FROM rev_ens) AS INT), 0)' for m in _meas)}
         AS trigger_count FROM rev_ens""", "rev_ens")


@query("R14", S.with_blocks(
    "SELECT doc_id, trigger_count, CAST(trigger_count >= 3 AS INT) AS trend_alert FROM rev_alert", "rev_alert"))
def trend_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.trend_alerts(ensemble_rows(spark, sf_dir)).select("doc_id", "trigger_count", "trend_alert")


_own = ", ".join(f"quantile_cont({m}, 0.95) AS q{i}" for i, m in enumerate(_meas))


@query("R14", S.with_blocks(f"""
SELECT doc_id, {' + '.join(f'coalesce(CAST({m} + 1e-12 >= q{i} AS INT), 0)' for i, m in enumerate(_meas))} AS trigger_count
FROM rev_ens JOIN (SELECT appid, {_own} FROM rev_ens GROUP BY appid) c USING (appid)""", "rev_ens"))
def trend_alerts_by_app(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.trend_alerts(ensemble_rows(spark, sf_dir), scope=("appid",)).select("doc_id", "trigger_count")


def with_coordinated(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """``rows`` with is_coordinated: whether the review of their doc_id is in a group of ten or more near copies of its app and day."""
    texts = reviews.where("review_content IS NOT NULL").select("appid", "doc_id", "ts", "review_content")
    marks, _ = coordinated.coordinated_marks(texts, "doc_id", "review_content", min_size=10)
    marks = marks.select("doc_id").distinct().withColumn("is_coordinated", F.lit(1))
    return rows.join(marks, "doc_id", "left").fillna(0, ["is_coordinated"])


@query("R17", S.with_blocks(f"""
SELECT appid, count(*) AS n_rows, CAST(sum(c) AS BIGINT) AS n_alerts, {S.s6('avg(c)')} AS alert_rate FROM (
  SELECT appid, CAST(risk_label_weak = 1 OR trigger_count >= 3 OR statistical_anomaly_score >= 2 OR ml_anomaly = 1
    OR doc_id IN (SELECT doc_id FROM {S.coordinated_blocks("crowd", ("appid",), 10)}) AS INT) AS c FROM rev_alert)
GROUP BY appid""", "rev_alert", "crowd_member"))
def composite_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_coordinated(anomaly.trend_alerts(ensemble_rows(spark, sf_dir)), V.reviews(spark, sf_dir))
    out = anomaly.composite_alert(rows)
    return out.groupBy("appid").agg(F.count("*").alias("n_rows"), F.sum("composite_alert").alias("n_alerts"),
                                    r6(F.avg("composite_alert")).alias("alert_rate"))


S.block("crisis", f"""
SELECT appid, update_id, count(*) FILTER ("window" = 'monitor') AS n, count(*) FILTER ("window" = 'baseline') AS nb,
       count(*) FILTER ("window" = 'monitor' AND sentiment_label = 'negative') AS nn,
       count(*) FILTER ("window" = 'monitor' AND risk_level = 'Critical') AS nc,
       count(*) FILTER ("window" = 'monitor' AND sentiment_label = 'negative' AND topic = 'monetization') AS nm,
       count(*) FILTER ("window" = 'monitor' AND risk_level IN ('Critical', 'High') AND trend_alert = 1) AS n2,
       0.2 + 0.1 * (CAST(substring(appid, 4) AS INT) % 3)::DOUBLE AS cut
FROM (SELECT m.*, {S.topic_case('processed')} AS topic, CAST(a.trigger_count >= 3 AS INT) AS trend_alert
      FROM monitored m JOIN rev_alert a USING (doc_id)) GROUP BY appid, update_id""", "monitored", "rev_alert")


@query("R13", S.with_blocks(f"""
SELECT appid, update_id, rule, severity, {S.s6('value')} AS value, {S.s6('threshold')} AS threshold FROM (
  SELECT appid, update_id, 'negative_surge' AS rule, 'HIGH' AS severity, nn / n AS value, cut AS threshold FROM crisis WHERE n > 0 AND nn / n > cut
  UNION ALL SELECT appid, update_id, 'critical_share', 'CRITICAL', nc / n, 0.05 FROM crisis WHERE n > 0 AND nc / n > 0.05
  UNION ALL SELECT appid, update_id, 'monetization_dispute', 'MEDIUM', nm / n, 0.30 FROM crisis WHERE n > 0 AND nm / n > 0.30
  UNION ALL SELECT appid, update_id, 'volume', 'MEDIUM', (n / 48.0::DOUBLE) / (nb / 168.0::DOUBLE), 3.0 FROM crisis
    WHERE nb > 0 AND (n / 48.0::DOUBLE) / (nb / 168.0::DOUBLE) > 3.0
  UNION ALL SELECT appid, update_id, 'combined', 'CRITICAL', n2, 10 FROM crisis WHERE n2 >= 10)""", "crisis"))
def crisis_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = save_table(risk_rows(spark, sf_dir).select(
        "appid", "doc_id", "ts", "compound", "sentiment_label", "votes_up", "topic", "risk_score", "risk_level",
        "risk_label_weak", F.length("review_content_processed").alias("text_length")), "scored")
    alerts = anomaly.trend_alerts(ensemble_rows(spark, sf_dir, rows)).select("doc_id", "trend_alert")
    tagged = monitor.in_window(rows, V.updates(spark, sf_dir)).join(alerts, "doc_id")
    updates = V.updates(spark, sf_dir).withColumn(
        "negative_sentiment_pct", F.expr("0.2D + 0.1D * (CAST(substring(appid, 4) AS INT) % 3)"))
    out = monitor.crisis_alerts(tagged, updates)
    return out.select(*KEYS, "rule", "severity", r6("value").alias("value"), r6("threshold").alias("threshold"))


@query("S16", f"""SELECT printf('- **%s** %s / %s: %s = %.4f (threshold %.4f)', severity, appid, update_id, rule,
       CAST(value AS DOUBLE), CAST(threshold AS DOUBLE)) AS line FROM ({REGISTRY["crisis_alerts"].sql})""")
def alert_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "alerts")
    sinks.write_alerts(crisis_alerts(spark, sf_dir), path)
    stored = spark.read.json(f"{path}/json").select("appid", "update_id", "rule").distinct()  # both files hold the same alerts
    lines = spark.read.text(f"{path}/markdown").select(F.col("value").alias("line"))
    key = F.regexp_extract("line", r"^- \*\*\w+\*\* (\S+) / (\S+): (\w+) ", 3)
    named = lines.select("line", F.regexp_extract("line", r" (\S+) / ", 1).alias("appid"), F.regexp_extract("line", r" / ([^:]+):", 1).alias("update_id"), key.alias("rule"))
    return named.join(stored, ["appid", "update_id", "rule"]).select("line")


S.block("hours", f"""
SELECT appid, date_trunc('hour', published_at) AS h, count(*) AS n,
       CAST(sum(coalesce(CAST({S.kw('title', ('update', 'patch'))} AS INT), 0)) AS BIGINT) AS k
FROM news_v GROUP BY ALL""", "news_v")


@query("R15", S.with_blocks(f"""
SELECT appid, {S.iso('h')} AS hour, n AS n_reviews, k AS n_keyword FROM (
  SELECT *, avg(n) OVER (PARTITION BY appid) AS m, stddev_samp(n) OVER (PARTITION BY appid) AS s FROM hours)
WHERE n > m + 2.5 * s AND k > 0""", "hours"))
def detected_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = monitor.detect_updates(V.news(spark, sf_dir).withColumnRenamed("published_at", "ts"), content="title")
    return out.select("appid", iso("hour").alias("hour"), "n_reviews", "n_keyword")


@query("R15")
def detected_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = changes.detect_changes(V.news(spark, sf_dir), ts="published_at")
    return out.select("appid", iso("hour").alias("hour"), "kind", "n_rows", r6("rate_before").alias("rate_before"), r6("rate_after").alias("rate_after"))


IN_48H = "ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts < TIMESTAMP '2024-01-10 00:00:00'"


@query("R16", S.with_blocks(f"""
SELECT review_id, appid, sentiment_label, {S.topic_case('processed')} AS topic, risk_score, risk_level FROM levelled WHERE {IN_48H}""", "levelled"))
def scored_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = monitor.score_window(V.reviews(spark, sf_dir), "2024-01-08 00:00:00")
    return out.select("review_id", "appid", "sentiment_label", "topic", "risk_score", "risk_level")


@query("R16", S.with_blocks(f"""
SELECT appid, count(*) AS n_reviews, {', '.join(f"count(*) FILTER (sentiment_label = '{v}') AS n_{v}" for v in LABELS)},
       {S.s6('avg(risk_score)')} AS mean_risk, max(risk_score) AS max_risk,
       count(*) FILTER (risk_level IN ('Critical', 'High')) AS n_high_risk, true AS alerts_fit FROM levelled WHERE {IN_48H} GROUP BY appid""", "levelled"))
def window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = monitor.window_summary(monitor.score_window(V.reviews(spark, sf_dir), "2024-01-08 00:00:00"))
    return out.select("appid", "n_reviews", *[f"n_{v}" for v in LABELS], r6("mean_risk").alias("mean_risk"), "max_risk", "n_high_risk",
                      F.col("n_trend_alerts").between(0, F.col("n_reviews")).alias("alerts_fit"))


@query("A4", S.with_blocks(f"""
SELECT event_id, {S.s6("coalesce(CASE WHEN event_type <> 'error' THEN value END, (SELECT median(value) FROM events_v WHERE event_type <> 'error'))")} AS value,
       coalesce(nullif(event_type, 'view'), '') AS event_type FROM events_v""", "events_v"))
def imputed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = V.scored_events(spark, sf_dir).selectExpr(
        "event_id", "CASE WHEN event_type <> 'error' THEN value END AS value", "nullif(event_type, 'view') AS event_type")
    out = anomaly.impute_features(ev, ["value"], ["event_type"])
    return out.select("event_id", r6("value").alias("value"), "event_type")


ML_FEATURES = ["value", "hourly_count", "user_id"]
S.block("ev_hours", "SELECT *, count(*) OVER (PARTITION BY appid, date_trunc('hour', ts)) AS hourly_count FROM events_v", "events_v")
mahalanobis("ev_ml", "ev_hours", tuple(ML_FEATURES))


@query("A2", S.with_blocks(f"""
SELECT event_id, {S.s6('ml')} AS ml_anomaly_score, CAST(ml > (SELECT quantile_cont(ml, 0.95) FROM ev_ml) AS INT) AS ml_anomaly
FROM ev_ml""", "ev_ml"))
def elliptic_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = timeline.add_hourly_count(V.scored_events(spark, sf_dir))
    out = anomaly.detect_elliptic(ev, ML_FEATURES)
    return out.select("event_id", r6("ml_anomaly_score").alias("ml_anomaly_score"), "ml_anomaly")


@query("A2")
def robust_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = timeline.add_hourly_count(V.scored_events(spark, sf_dir))
    out = anomaly.detect_robust(ev, ML_FEATURES)
    return out.select("event_id", r6("ml_anomaly_score").alias("ml_anomaly_score"), "ml_anomaly")


@query("A2")
def isolation_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = timeline.add_hourly_count(V.scored_events(spark, sf_dir))
    out = anomaly.detect_isolation(ev, ML_FEATURES, "event_id")
    return out.select("event_id", r6("ml_anomaly_score").alias("ml_anomaly_score"), "ml_anomaly")


S.block("all_tagged", """
SELECT r.*, u.update_id, CASE WHEN r.ts < u.update_ts THEN 'pre' ELSE 'post' END AS "window"
FROM rev_s r JOIN updates_v u ON u.appid = r.appid
 AND r.ts >= u.update_ts - INTERVAL 7 DAY AND r.ts <= u.update_ts + INTERVAL 7 DAY""", "rev_s", "updates_v")
S.window_stats("all_stats", "all_tagged")
S.block("bt_src", "SELECT *, NULL::DOUBLE AS cneg FROM all_stats", "all_stats")
S.block("bt_sig", f"SELECT *, {S.RANK} AS severity_rank FROM ({S.SIGNALS.format(src='bt_src')})", "bt_src")
S.block("bt", """
SELECT appid, update_id, pre_n, post_n, pre_negative, post_negative, neg_delta, overall_risk, n_signals, ok AS data_ok,
       CASE WHEN ok THEN list_contains(expected_risk, overall_risk) END AS pass_risk,
       CASE WHEN ok THEN CASE expected_delta WHEN '-' THEN neg_delta > 0 WHEN '+' THEN neg_delta < 0 ELSE true END END AS pass_delta
FROM (SELECT s.*, round_even(post_negative - pre_negative, 4) + 0.0 AS neg_delta, pre_n >= 10 AND post_n >= 10 AS ok,
        CASE coalesce(mx, 1) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS overall_risk,
        CAST(coalesce(ns, 0) AS INT) AS n_signals,
        CASE CAST(substring(s.appid, 4) AS INT) % 2 WHEN 0 THEN ['LOW'] ELSE ['LOW', 'MEDIUM', 'HIGH'] END AS expected_risk,
        CASE CAST(substring(s.appid, 4) AS INT) % 3 WHEN 0 THEN '-' WHEN 1 THEN '+' ELSE '?' END AS expected_delta
      FROM all_stats s LEFT JOIN (SELECT update_id, max(severity_rank) AS mx, count(*) AS ns FROM bt_sig GROUP BY ALL) g USING (update_id))
""", "all_stats", "bt_sig")


def backtest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = V.updates(spark, sf_dir).withColumns({
        "expected_risk": F.expr("if(CAST(substring(appid, 4) AS INT) % 2 = 0, array('LOW'), array('LOW', 'MEDIUM', 'HIGH'))"),
        "expected_delta": F.expr("CASE CAST(substring(appid, 4) AS INT) % 3 WHEN 0 THEN '-' WHEN 1 THEN '+' ELSE '?' END"),
    })
    return bt.backtest(V.reviews(spark, sf_dir), cases)


@query("R8, F10", S.with_blocks(f"""
SELECT * REPLACE ({S.s6('pre_negative')} AS pre_negative, {S.s6('post_negative')} AS post_negative),
       pass_risk AND pass_delta AS passed FROM bt""", "bt"))
def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backtest_results(spark, sf_dir)
    return out.withColumns({c: r6(c) for c in ("pre_negative", "post_negative")})


@query("R8", S.with_blocks("""
SELECT count(*) AS n_total, count(*) FILTER (data_ok) AS n_ran, count(*) FILTER (pass_risk AND pass_delta) AS n_passed,
       count(*) FILTER (NOT data_ok) AS n_skipped FROM bt""", "bt"))
def backtest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.backtest_summary(backtest_results(spark, sf_dir))


__all__ = ["scored_reviews"]
