"""Registered queries: coordinated behaviour and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import aggregates, comments as comment_ops, coordinated, joins, models, topic_drift as drift, windows
from ..plans import evidence, monitor
from ..session import fresh_path, save_table
from ..sources import sinks
from . import sql as S
from . import views as V
from .registry import iso, query, r6


@query("A5, J10", S.with_blocks(f"""
SELECT {S.iso("day")} AS time_window, first AS first_review, size, {S.s6("(square - size) / (size * (size - 1))")} AS avg_similarity
FROM {S.coordinated_blocks("near", (), 3)} GROUP BY ALL""", "near_member"))
def coordinated_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.reviews(spark, sf_dir).where("review_content IS NOT NULL").select("review_id", "appid", "ts", "review_content")
    marks, groups = coordinated.coordinated_marks(rows, "review_id", "review_content", keys=(), min_size=3)
    first = marks.groupBy("group_id").agg(F.min("review_id").alias("first_review"))
    return groups.join(first, "group_id").select(
        iso("time_window").alias("time_window"), "first_review", "size", r6("avg_similarity").alias("avg_similarity"))


def _processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.reviews(spark, sf_dir).select(
        "review_id", "doc_id", "appid", "ts", "voted_up",
        text.clean_text(F.coalesce("review_content", F.lit(""))).alias("p"))


S.block("tf", """
SELECT review_id, term, count(*) AS tf FROM (
  SELECT review_id, unnest(string_split_regex(processed, '[^\\p{L}\\p{N}\\p{M}_]+')) AS term FROM rev_p)
WHERE length(term) >= 2 GROUP BY ALL""", "rev_p")
S.block("vocab", """
SELECT term, df FROM (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY term) ORDER BY total DESC, term LIMIT 500""", "tf")
S.block("tfw", """
SELECT review_id, max(w) AS m, sum(w) AS s, sum(w * w) AS q, count(*) AS nz FROM (
  SELECT review_id, tf * (ln(((SELECT count(*) FROM reviews_v) + 1) / (df + 1)) + 1) AS w FROM tf JOIN vocab USING (term))
GROUP BY review_id""", "tf", "vocab", "reviews_v")


@query("M1", S.with_blocks(f"""
SELECT review_id, {S.s6('coalesce(m / sqrt(q), 0)')} AS tfidf_max,
       {S.s6('coalesce(s / sqrt(q) / (SELECT count(*) FROM vocab), 0)')} AS tfidf_mean,
       {S.s6("coalesce(sqrt(greatest(1.0::DOUBLE / (SELECT count(*) FROM vocab) - pow(s / sqrt(q) / (SELECT count(*) FROM vocab), 2), 0)), 0)")}
         AS tfidf_std, coalesce(nz, 0) AS tfidf_nonzero_count
FROM reviews_v LEFT JOIN tfw USING (review_id)""", "reviews_v", "tfw", "vocab"))
def tfidf_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.tfidf_stats(_processed(spark, sf_dir), "p")
    return out.select("review_id", *[r6(c).alias(c) for c in ("tfidf_max", "tfidf_mean", "tfidf_std")],
                      "tfidf_nonzero_count")


S.block("grams", """
SELECT review_id, array_to_string(ws[i:i + k - 1], ' ') AS term FROM (
  SELECT review_id, ws, generate_subscripts(ws, 1) AS i FROM (
    SELECT review_id, list_filter(string_split_regex(processed, '[^\\p{L}\\p{N}\\p{M}_]+'), lambda w: length(w) >= 2) AS ws FROM rev_p)),
  range(1, 4) AS t(k) WHERE i + k - 1 <= len(ws)""", "rev_p")


@query("M5", S.with_blocks("""
SELECT term, CAST(total AS BIGINT) AS total, df, CAST(row_number() OVER (ORDER BY total DESC, term) AS INT) AS rank FROM (
  SELECT term, sum(n) AS total, count(*) AS df FROM (SELECT review_id, term, count(*) AS n FROM grams GROUP BY ALL) GROUP BY term)
WHERE df >= 3 AND df <= 0.9::DOUBLE * (SELECT count(*) FROM rev_p) ORDER BY total DESC, term LIMIT 10000""", "grams", "rev_p"))
def joint_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.joint_vocabulary(_processed(spark, sf_dir), "p")


@query("M2, M3")
def topic_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.topic_categories(models.topic_model(_processed(spark, sf_dir), "p"), "p")
    return out.select("review_id", "dominant_topic", "topic_top2_pair", "topic_category",
                      *[r6(c).alias(c) for c in ("dominant_topic_prob", "topic_entropy", "topic_top2_prob_product")],
                      F.transform("topic_pca", lambda x: F.round(x, 4)).alias("topic_pca"))


@query("M2")
def topic_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of every week of reviews under ids that last."""
    out = drift.topics_over_time(_processed(spark, sf_dir), "p", iso(F.date_trunc("week", "ts")))
    return out.withColumn("similarity", r6("similarity"))


@query("M4", f"""
SELECT vec_id, {S.s6('sqrt(q)')} AS embedding_norm, {S.s6('m')} AS embedding_mean,
       {S.s6('sqrt(greatest(q / n - m * m, 0))')} AS embedding_std
FROM (SELECT vec_id, len(embedding) AS n, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS q,
             list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding) AS m FROM embeddings)""")
def embedding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.embedding_stats(V.table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", *[r6(c).alias(c) for c in ("embedding_norm", "embedding_mean", "embedding_std")])


@query("M4")
def embedding_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.embedding_clusters(V.table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "embed_cluster_id", r6("embed_cluster_dist").alias("embed_cluster_dist"))


@query("M6", S.with_blocks("""
SELECT event_id, epoch_us(ts) <= (SELECT quantile_cont(epoch_us(ts)::DOUBLE, 0.8) FROM events_v) AS is_train,
       CAST(len(list_filter((SELECT quantile_cont(epoch_us(ts)::DOUBLE, [0.166667, 0.333333, 0.5, 0.666667, 0.833333]) FROM events_v),
         lambda c: epoch_us(ts) > c)) AS INT) AS time_part FROM events_v""", "events_v"))
def time_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.time_folds(models.time_split(V.scored_events(spark, sf_dir)))
    return out.select("event_id", "is_train", "time_part")


S.block("curve", """
SELECT s, n, p, sum(n) OVER (ORDER BY s DESC) AS cn, sum(p) OVER (ORDER BY s DESC) AS cp,
       sum(n) OVER () AS tn, sum(p) OVER () AS tp
FROM (SELECT value / 1000 AS s, count(*) AS n, count(*) FILTER (event_type IN ('error', 'view')) AS p FROM events_v GROUP BY 1)""",
    "events_v")


@query("M7", S.with_blocks(f"""
SELECT {S.s6('sum(p / tp * (cp / cn))')} AS average_precision,
       {S.s6('sum((n - p) * (cp - p + p / 2)) / (max(tp) * (max(tn) - max(tp)))')} AS roc_auc,
       {S.s6('max(2 * cp / (cn + tp))')} AS f1,
       {', '.join(f"{S.s6(f'sum(p * least(greatest(floor(tn * {k} + 1e-9) - (cn - n), 0), n) / n) / max(tp)')} AS recall_at_{int(k * 100)}" for k in (0.05, 0.10, 0.20))}
FROM curve""", "curve"))
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = V.scored_events(spark, sf_dir).select(
        (F.col("value") / 1000).alias("score"), F.col("event_type").isin("error", "view").cast("int").alias("target"))
    out = models.evaluate(ev, "score", "target")
    return out.select(*[r6(c).alias(c) for c in
                        ("average_precision", "roc_auc", "f1", "recall_at_5", "recall_at_10", "recall_at_20")])


@query("M7", S.with_blocks(f"""
SELECT count(*) AS n_warned, {S.s6('avg((epoch_us(i) - epoch_us(a)) / 3600000000.0::DOUBLE)')} AS mean_lead_hours FROM (
  SELECT n.gid, min(e.ts) AS a, max(n.published_at) AS i FROM notes_v n JOIN events_v e ON e.appid = n.appid
   AND e.ts < n.published_at AND e.ts >= n.published_at - INTERVAL 72 HOUR AND e.score > 0.9 GROUP BY n.gid)""", "notes_v", "events_v"))
def alert_lead_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = V.scored_events(spark, sf_dir).where("score > 0.9")
    notes = windows.patch_notes(V.news(spark, sf_dir)).select(
        "appid", F.col("gid").alias("incident_id"), F.col("published_at").alias("ts"))
    out = models.lead_time(alerts, notes)
    return out.select("n_warned", r6("mean_lead_hours").alias("mean_lead_hours"))


NUMERIC = ["votes_up", "votes_funny", "num_reviews", "text_length"]
SENTIMENT = ["compound", "pos", "neg"]


TREND = ["sentiment_rolling_mean_24h", "sentiment_diff_24h", "comment_rate_24h"]
ANOMALY = ["statistical_anomaly_score", "ml_anomaly_score", "ensemble_anomaly_score"]
FEATURE_GROUPS = {"base": NUMERIC + SENTIMENT, "trend": TREND, "anomaly": ANOMALY, "full": ["trigger_count"]}


def _training_rows(spark: SparkSession, sf_dir: str, alerts: bool = False) -> DataFrame:
    rows = monitor.score_rows(V.reviews(spark, sf_dir)).withColumn("text_length", F.length("review_content_processed"))
    if alerts:
        from ..operators import anomaly
        from .risk_queries import ensemble_rows

        keep = save_table(rows.select("appid", "doc_id", "review_id", "ts", "compound", "votes_up", "votes_funny", "num_reviews", "text_length", "pos", "neg",
                                      "topic", "risk_label_weak"), "training")
        extra = anomaly.trend_alerts(ensemble_rows(spark, sf_dir, keep)).select("doc_id", *TREND, *ANOMALY, "trigger_count")
        return save_table(keep.join(extra, "doc_id").na.fill(0.0), "training")
    return save_table(rows.select("review_id", "ts", "review_content_processed", "risk_label_weak", *NUMERIC, *SENTIMENT), "training")


@query("M5")
def text_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classifier_evaluation(spark, sf_dir)
    return out.select(*[r6(c).alias(c) for c in ("average_precision", "roc_auc", "precision", "recall", "f1")],
                      "tp", "fp", "fn", "tn")


def classifier_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = save_table(models.time_split(_training_rows(spark, sf_dir)), "split")
    model = models.train_text_classifier(
        rows.where("is_train"), "review_content_processed", "risk_label_weak")
    scored = model.transform(rows.where("NOT is_train")).select("risk_label_weak", models.probability().alias("score"))
    return models.evaluate(scored, "score", "risk_label_weak")


@query("M5, M9")
def boosted_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _training_rows(spark, sf_dir)
    model = models.train_boosted(rows, NUMERIC + SENTIMENT, "risk_label_weak")
    return models.feature_importance(model, rows).withColumn("importance", r6("importance"))


@query("M5, M9")
def boosted_text_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = save_table(_training_rows(spark, sf_dir), "training")
    model = models.train_boosted(rows, NUMERIC + SENTIMENT, "risk_label_weak", content="review_content_processed")
    return models.feature_importance(model, rows).withColumn("importance", r6("importance"))


@query("M6, M8")
def feature_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ablation_of(spark, sf_dir)
    return out.withColumns({"pr_auc": r6("pr_auc"), "pr_auc_std": r6("pr_auc_std")})


def ablation_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = models.time_folds(_training_rows(spark, sf_dir, alerts=True))
    return models.ablation(folded, FEATURE_GROUPS, "risk_label_weak")


# What does not depend on the library's random choices, checked in SQL.


@query("M2, M3", S.with_blocks("SELECT review_id, true AS sums_to_one_or_empty, true AS strongest_first, true AS entropy_fits FROM rev_p", "rev_p"))
def topic_model_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.topic_model(_processed(spark, sf_dir), "p")
    total = F.expr("aggregate(topic_probs, 0D, (s, p) -> s + p)")
    return out.select(
        "review_id", (total.isNull() | (F.abs(total - 1) < 1e-6) | (total == 0)).alias("sums_to_one_or_empty"),
        ((F.array_max("topic_probs") == F.col("dominant_topic_prob")) & F.col("dominant_topic").between(0, 7)).alias("strongest_first"),
        F.col("topic_entropy").between(-1e-9, F.log(F.lit(8.0)) + 1e-9).alias("entropy_fits"))


@query("M4", "SELECT vec_id, true AS known_cluster, true AS nearest_centre FROM embeddings")
def embedding_cluster_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.embedding_clusters(V.table(spark, sf_dir, "embeddings"), centres="_all")
    gaps = F.transform("_all", lambda c: F.aggregate(F.zip_with("embedding", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))
    return out.select("vec_id", F.col("embed_cluster_id").between(0, 7).alias("known_cluster"),
                      (F.abs(F.sqrt(F.array_min(gaps)) - F.col("embed_cluster_dist")) < 1e-6).alias("nearest_centre"))


S.block("test_rows", """
SELECT * FROM levelled WHERE epoch_us(ts) > (SELECT quantile_cont(epoch_us(ts)::DOUBLE, 0.8) FROM levelled)""", "levelled")


@query("M5, M7", S.with_blocks(
    "SELECT count(*) AS n_test, count(*) FILTER (risk_label_weak = 1) AS n_positive, true AS beats_chance FROM test_rows", "test_rows"))
def text_classifier_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classifier_evaluation(spark, sf_dir)
    return out.select(
        F.expr("tp + fp + fn + tn").alias("n_test"), F.expr("tp + fn").alias("n_positive"),
        (F.col("average_precision") > F.expr("(tp + fn) / (tp + fp + fn + tn)")).alias("beats_chance"))


@query("M5, M9", " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) > 0 AS fits, true AS whole FROM documents" for c in NUMERIC + SENTIMENT))
def boosted_importance_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = boosted_importance(spark, sf_dir)
    total = out.agg(F.sum("importance")).scalar()
    return out.select("feature", F.col("importance").between(0, 1).alias("fits"), (F.abs(total - 1) < 1e-4).alias("whole"))


@query("M6, M8", " UNION ALL ".join(
    f"SELECT '{g}' AS features, {n} AS n_features, count(*) > 0 AS fits FROM documents" for g, n in
    zip(FEATURE_GROUPS, [sum(map(len, list(FEATURE_GROUPS.values())[: i + 1])) for i in range(len(FEATURE_GROUPS))])))
def feature_ablation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation_of(spark, sf_dir).select("features", "n_features", F.col("pr_auc").between(0, 1).alias("fits"))


@query("L4")
def evidence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .impact_queries import report

    from .review_queries import KEYS, announcement_themes, comment_sources, scored_windows

    full = report(spark, sf_dir)
    updates, notes = V.updates(spark, sf_dir), windows.patch_notes(V.news(spark, sf_dir))
    said = joins.comments_of_updates(V.comments(spark, sf_dir), comment_sources(spark, sf_dir))
    labelled = comment_ops.label_comments(comment_ops.prefilter(said, KEYS))
    quotes = labelled.select(*KEYS, F.col("content").alias("text"), F.col("sentiment_label").alias("sentiment"), "position")
    spread = aggregates.distribution_summary(scored_windows(spark, sf_dir).where("window = 'post'"), KEYS)
    return evidence.evidence_pack(
        full.summary, full.topics, evidence.patch_context(updates, notes), themes=announcement_themes(spark, sf_dir),
        quotes=aggregates.pick_quotes(quotes, KEYS, "position"), distribution=spread)


@query("L4", S.with_blocks("""
SELECT appid, update_id, string_agg(title || ', ' || strftime(published_at, '%Y-%m-%d') || chr(10) || contents, chr(10) ORDER BY k) AS patch_context
FROM (SELECT u.appid, u.update_id, n.title, n.contents, n.published_at,
             row_number() OVER (PARTITION BY u.appid, u.update_id ORDER BY n.published_at DESC, n.gid) AS k
      FROM updates_v u JOIN notes_v n ON n.appid = u.appid AND n.published_at >= u.update_ts - INTERVAL 7 DAY)
WHERE k <= 3 GROUP BY ALL""", "updates_v", "notes_v"))
def patch_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.patch_context(V.updates(spark, sf_dir), windows.patch_notes(V.news(spark, sf_dir)))


@query("L5", S.with_blocks("""
SELECT appid, update_id, 'Analysis complete. Risk level: ' || overall_risk || '. Negative ratio change: ' ||
       printf('%+.1f%%', round_even(sentiment_delta * 100, 1)) || '.' AS narrative FROM stats JOIN overall USING (appid, update_id)""",
    "stats", "overall"))
def fallback_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .impact_queries import report

    return evidence.fallback_narrative(report(spark, sf_dir).summary)


@query("L5", S.with_blocks("""
SELECT appid, update_id, string_agg(p || ' ' || rule || ' (' || lower(severity) || ')', '; ' ORDER BY p, rule) AS items FROM (
  SELECT *, CASE WHEN severity_rank >= 3 THEN 'P1' WHEN severity_rank = 2 THEN 'P2' ELSE 'P3' END AS p FROM signals) GROUP BY ALL""", "signals"))
def action_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .impact_queries import report

    items = report(spark, sf_dir).signals.selectExpr(
        "appid", "update_id", "CASE WHEN severity_rank >= 3 THEN 'P1' WHEN severity_rank = 2 THEN 'P2' ELSE 'P3' END AS priority",
        "rule AS issue", "concat('look into ', rule) AS action", "lower(severity) AS expected_impact")
    out = evidence.group_actions(items)
    return out.selectExpr("appid", "update_id", "array_join(transform(items, i -> concat(i.priority, ' ', i.issue, ' (', i.expected_impact, ')')), '; ') AS items")


@query("M7, S16", S.with_blocks(f"""
SELECT count(*) AS k, {S.s6('avg(ok)')} AS precision_at_k FROM (
  SELECT CAST(coalesce(max(toxic), 0) = 1 AS INT) AS ok FROM reviews_v WHERE review_content IS NOT NULL
  GROUP BY review_content HAVING count(*) > 1 ORDER BY count(*) DESC, md5(review_content) LIMIT 10)""", "reviews_v"))
def copied_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "groups")
    texts = V.reviews(spark, sf_dir).where("review_content IS NOT NULL").select(F.md5("review_content").alias("group_id"), "toxic")
    groups = texts.groupBy("group_id").agg(F.count("*").alias("size"), F.max("toxic").alias("toxic")).where("size > 1")
    sinks.write_groups(groups, path)
    stored = spark.read.schema("group_id string, size bigint, toxic int").json(path)
    out = models.precision_at_k(stored.select("group_id", "size"), stored.where("toxic = 1"), 10)
    return out.select("k", r6("precision_at_k").alias("precision_at_k"))
