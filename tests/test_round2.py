"""Faults that the catalogue's tables cannot show: comments of the right update, lexicons, tiny scores, outliers, plans."""

import random

import pytest
from pyspark.sql import functions as F

from patchpulse.functions import features, sentiment, text
from patchpulse.operators import joins, models, quantiles, risk, windows
from patchpulse.plans import impact

TS = "timestamp'{}'"


def updates_of(spark, rows):
    df = spark.createDataFrame(rows, "appid string, update_id string, at string, pre_days int, post_days int")
    return df.withColumn("update_ts", F.to_timestamp("at")).drop("at")


@pytest.fixture
def two_updates(spark):
    updates = updates_of(spark, [("7", "u1", "2024-01-10 00:00:00", 7, 7), ("7", "u2", "2024-03-10 00:00:00", 7, 7), ("7", "u3", "2024-06-10 00:00:00", 7, 7)])
    events = spark.createDataFrame(
        [("7", "g1", "t1", "first", "2024-01-09 12:00:00"), ("7", "g2", "t2", "second", "2024-03-11 00:00:00"), ("7", "g0", "", "no topic", "2024-03-10 00:00:00"),
         ("7", "g9", "t9", "no comments", "2024-06-10 00:00:00")],
        "appid string, gid string, forum_topic_id string, event_name string, at string").withColumn("event_ts", F.to_timestamp("at")).drop("at")
    comments = spark.createDataFrame(
        [("7", "t1", "c1", "terrible awful crash", 1), ("7", "t1", "c2", "worst garbage ever", 2), ("7", "t2", "c3", "great fun, love it", 3), ("7", "t9", "c4", "  ", 4)],
        "appid string, forum_topic_id string, comment_id string, content string, position int")
    return updates, events, comments


def test_each_update_has_the_comments_of_its_own_topic(spark, two_updates):
    updates, events, comments = two_updates
    notes = spark.createDataFrame([], "appid string, gid string, title string, published_at timestamp")
    reviews = spark.createDataFrame([("7", "r1", "fine", True, "2024-01-11 00:00:00")], "appid string, review_id string, review_content string, voted_up boolean, at string")
    reviews = reviews.withColumn("ts", F.to_timestamp("at")).withColumns({"playtime_at_review": F.lit(600.0), "num_reviews": F.lit(1)})
    report = impact.impact_report(reviews, updates, comments, events, notes)
    got = {r.update_id: (r.n_comments, r.comment_negative) for r in report.summary.collect()}
    assert got == {"u1": (2, 1.0), "u2": (1, 0.0), "u3": (1, 0.0)}
    assert {r.update_id for r in report.signals.where("rule = 'R4'").collect()} == {"u1"}
    with pytest.raises(ValueError):
        impact.impact_report(reviews, updates, comments)


def test_notes_count_from_the_start_of_the_window(spark, two_updates):
    updates, events, comments = two_updates
    notes = spark.createDataFrame([("7", "t1", "old", "2023-12-01 00:00:00"), ("7", "t2", "new", "2024-03-04 00:00:00")], "appid string, gid string, title string, at string")
    notes = notes.withColumn("published_at", F.to_timestamp("at"))
    got = {r.update_id: (r.comment_source, r.gid) for r in joins.nearest_comment_source(updates, events.limit(0), notes, comments).collect()}
    # u1: the old note lies before its window, the new one is after the update; u3: both lie before its window
    assert got == {"u1": ("patch_note", "t2"), "u2": ("patch_note", "t2"), "u3": (None, None)}


def test_no_cap_on_candidates(spark, two_updates):
    updates, _, comments = two_updates
    rows = [("7", f"e{i:03}", f"x{i}", "quiet", f"2024-01-{10 + i % 3:02} 0{i % 10}:00:00") for i in range(60)] + [("7", "far", "t2", "far", "2023-06-01 00:00:00")]
    events = spark.createDataFrame(rows, "appid string, gid string, forum_topic_id string, event_name string, at string").withColumn("event_ts", F.to_timestamp("at"))
    topics = joins.usable_topics(comments)
    assert {r.gid for r in joins.nearest_with_comments(updates, events, topics).collect()} == {"far"}


def test_lexicon_of_any_case_and_size(spark, tmp_path, monkeypatch):
    path = tmp_path / "lexicon.txt"
    path.write_text("Good\t1.0\t0.1\ngood\t3.0\t0.1\nBAD\t-2.0\t0.1\n")
    lexicon = sentiment.read_lexicon(spark, str(path))
    assert {r.word: r.valence for r in lexicon.where("valence IS NOT NULL").collect()} == {"good": 2.0, "bad": -2.0}
    df = spark.createDataFrame([(1, "very good!"), (2, "not bad but good"), (3, None), (4, "very good!")], "id int, review_content_processed string")
    one = sorted(sentiment.add_sentiment(df, lexicon=lexicon).collect())
    monkeypatch.setattr(sentiment, "MAX_INDEX_WORDS", 1)
    two = sentiment.add_sentiment(df, lexicon=lexicon)
    assert sorted(two.select(*["id", "review_content_processed", "compound", "pos", "neu", "neg", "sentiment_label"]).collect()) == one


def test_backfill_scores_missing_rows_without_a_join(spark):
    df = spark.createDataFrame([(1, "great", None), (2, "great", 0.25), (3, None, None)], "id int, review_content string, compound double")
    out = features.backfill_sentiment(df)
    got = {r.id: r.compound for r in out.collect()}
    assert got[2] == 0.25 and got[1] > 0.5 and got[3] == 0.0
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_tiny_scores_are_ranked(spark):
    rows = [(k * 1e-11, int(k > 50)) for k in range(100)]
    out = models.evaluate(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    assert out.average_precision == pytest.approx(1.0) and out.roc_auc == pytest.approx(1.0)


def test_quantiles_with_an_outlier(spark):
    rng = random.Random(1)
    values = [rng.random() for _ in range(20_000)] + [1e12]
    got = quantiles.exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", (0.5, 0.95)).first()
    ordered = sorted(values)
    assert got.p50 == pytest.approx(ordered[10_000]) and got.p95 == pytest.approx(ordered[19_000])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as for inputs that fill their partitions
    try:
        ranges = quantiles.in_ranges(spark.createDataFrame([(v,) for v in values], "v double"), "v").groupBy("bin").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in ranges) < len(values) / 2


def test_gray_queue_numbers_whole_groups(spark):
    df = spark.range(300).selectExpr("'a' AS k", "CAST(id AS STRING) AS review_id", "timestamp_seconds(id * 7200) AS ts", "0.0D AS compound")
    got = windows.gray_queue(df, ["k"]).orderBy("ts").collect()
    assert [r.queue_pos for r in got] == list(range(1, 301))
    assert windows.gray_queue(df, ["k"], 5).count() == 5


def test_overall_risk_of_no_signals(spark, two_updates):
    none = spark.createDataFrame([], "appid string, update_id string, severity_rank int")
    assert {r.overall_risk for r in risk.overall_risk(none, two_updates[0]).collect()} == {"LOW"}
    assert text.PUNCTUATION


def test_store_keys_keep_their_zeros(spark, tmp_path):
    from patchpulse.sources import reviews

    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("007", "r1", "a", "2024-01-01 00:00:00"), ("7", "r1", "b", "2024-01-01 00:00:00")], "appid string, review_id string, review_content string, at string")
    rows = rows.withColumn("ts", F.to_timestamp("at")).drop("at")
    assert reviews.ingest_reviews(rows, path) == 2
    assert reviews.ingest_reviews(rows, path) == 0
    assert {r.appid for r in reviews.read_store(spark, path).collect()} == {"007", "7"}
    plan = reviews.new_rows(rows.where("appid = '7'"), reviews.stored(spark, path, rows.schema), ["appid", "review_id"], F.struct("ts"))
    assert "PartitionFilters: [" in plan._jdf.queryExecution().executedPlan().toString()


def test_evidence_sections(spark, two_updates):
    from patchpulse.plans import evidence

    updates, events, comments = two_updates
    notes = spark.createDataFrame([("7", "n1", "Fix", "x" * 1000, "2024-01-09 00:00:00")], "appid string, gid string, title string, contents string, at string")
    notes = notes.withColumn("published_at", F.to_timestamp("at"))
    reviews = spark.createDataFrame([("7", "r1", "terrible crash, bad game", True, "2024-01-11 00:00:00")], "appid string, review_id string, review_content string, voted_up boolean, at string")
    reviews = reviews.withColumn("ts", F.to_timestamp("at")).withColumns({"playtime_at_review": F.lit(600.0), "num_reviews": F.lit(1)})
    report = impact.impact_report(reviews, updates, comments, events, notes)
    themes = spark.createDataFrame([("7", "u1", f"theme{i}", i) for i in range(9)], "appid string, update_id string, label string, count int")
    quotes = spark.createDataFrame([("7", "u1", f"quote {i}", "negative", i) for i in range(12)], "appid string, update_id string, text string, sentiment string, position int")
    spread = spark.createDataFrame([("7", "u1", "Of 1 reviews, all recommend.")], "appid string, update_id string, summary string")
    context = evidence.patch_context(updates, notes)
    got = {r.update_id: r.evidence for r in evidence.evidence_pack(report.summary, report.topics, context, None, themes, quotes, spread).collect()}
    first = got["u1"]
    assert "Fix, 2024-01-09" in first and "x" * 1000 in first and "Of 1 reviews, all recommend." in first
    assert first.count("- theme") == 6 and first.count("quote ") == 10 and "contradicts the vote" in first
    assert "# After the update" not in got["u3"] and "# Patch notes" not in got["u3"]
    cut = evidence.patch_context(updates, notes, chars=800).first().patch_context
    assert len(cut) == len("Fix, 2024-01-09\n") + 800


def test_evidence_query_folds_copied_comments(spark, monkeypatch):
    from patchpulse.catalog import REGISTRY, model_queries, review_queries

    small, views = "/root/testdata/sf0.001", model_queries.V
    update = review_queries.comment_sources(spark, small).where("forum_topic_id IS NOT NULL").first()
    said = [(f"c{i}", "buy  cheap coins here", i) for i in range(12)] + [("w", "This comment is awaiting analysis by our system", 20)]
    said += [("n", "terrible crash, awful game", 21), ("p", "wonderful patch, great fun", 22), ("s", "gg", 23)]
    rows = [(update.appid, update.forum_topic_id, c, t, "user", 0, n) for c, t, n in said]
    copied = spark.createDataFrame(rows, "appid string, forum_topic_id string, comment_id string, content string, author string, upvotes int, position bigint")
    real = views.comments
    others = real(spark, small).where(F.col("forum_topic_id") != update.forum_topic_id)
    monkeypatch.setattr(views, "comments", lambda *_: others.unionByName(copied))
    pack = REGISTRY["evidence_pack"].run(spark, small).where((F.col("appid") == update.appid) & (F.col("update_id") == update.update_id)).first().evidence
    assert pack.count('buy  cheap coins here"') == 1 and "awaiting analysis" not in pack and '"gg"' not in pack
    assert '- negative: "terrible crash, awful game"' in pack and '- positive: "wonderful patch, great fun"' in pack and "- user:" not in pack
    packs = [r.evidence for r in REGISTRY["evidence_pack"].run(spark, small).collect()]
    assert any("recommend the product" in p for p in packs) and all(("recommend the product" in p) == ("# After the update" in p) for p in packs)


def test_composite_alert_takes_coordinated_and_model_flags(spark):
    from patchpulse.operators import anomaly

    names = ("risk_label_weak", "trend_alert", "is_statistical_anomaly", "ml_anomaly", "is_coordinated")
    rows = [tuple(int(i == k) for k in range(5)) for i in range(6)]
    got = anomaly.composite_alert(spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))).collect()
    assert [r.composite_alert for r in got] == [1, 1, 1, 1, 1, 0]


def test_monitoring_settings_of_an_update(spark):
    from patchpulse.plans import monitor

    rows = spark.createDataFrame([("a", h) for h in range(-72, 72)], "appid string, h int").selectExpr("appid", "timestamp'2024-01-10 00:00:00' + make_dt_interval(0, h) AS ts")
    updates = spark.createDataFrame([("a", "u1", 24, 1, True), ("a", "u2", None, None, None), ("a", "u3", 24, 1, False)], "appid string, update_id string, window_hours int, baseline_days int, enabled boolean")
    updates = updates.withColumn("update_ts", F.expr("timestamp'2024-01-10 00:00:00'"))
    got = {(r.update_id, r.window): r["count"] for r in monitor.in_window(rows, updates).groupBy("update_id", "window").count().collect()}
    assert got == {("u1", "monitor"): 24, ("u1", "baseline"): 24, ("u2", "monitor"): 48, ("u2", "baseline"): 72}
