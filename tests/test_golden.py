"""Small rows with known answers: cleaning, labels, windows, signals, summaries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from patchpulse import config
from patchpulse.functions import features, sentiment, text
from patchpulse.operators import aggregates, cleaning, comments, risk, windows

UTC = "2024-03-20 00:00:00"


def reasons(spark, rows, columns="review_content string, playtime_at_review double, num_reviews int"):
    df = spark.createDataFrame(rows, columns)
    return [r.exclude_reason for r in df.withColumn("exclude_reason", cleaning.exclude_reason(df)).collect()]


def test_every_reason_alone(spark):
    rows = [
        ("A solid update with good maps", 600.0, 1), ("...", 600.0, 1), ("", 600.0, 1), (None, 600.0, 1),
        (" \t \n", 600.0, 1), ("привет как дела", 600.0, 1), ("🎮🎮🎮", 600.0, 1), ("_", 600.0, 1),
        ("a" * 10, 600.0, 1), ("a" * 9, 600.0, 1), ("x x x y", 600.0, 1), ("x x x x", 600.0, 1),
        ("http://a https://b ok", 600.0, 1), ("http://a ok", 600.0, 1), ("fine game", 29.0, 1),
        ("fine game", 100.0, 6), ("fine game", 100.0, 5), ("fine game", 599.0, 51), ("fine game", None, None),
    ]
    assert reasons(spark, rows) == [
        None, "punctuation_only", "null_or_empty", "null_or_empty", "null_or_empty", "non_english", "punctuation_only",
        None, "repeated_char", None, None, "repetitive_words", "multiple_urls", None, "behavioral_spam",
        "behavioral_spam", None, "behavioral_spam", None,
    ]


def test_reason_precedence(spark):
    every = "aaaaaaaaaaaa http://x http://y " + "w " * 40
    assert reasons(spark, [(every, 1.0, 1), (every, 999.0, 1), ("aaaaaaaaaaaa " + "w " * 40, 999.0, 1), ("...", 1.0, 1)]) == [
        "behavioral_spam", "multiple_urls", "repetitive_words", "punctuation_only"]


def test_cleaning_without_behaviour_columns(spark):
    df = spark.createDataFrame([("Great update, well done",), ("...",), ("",)], "review_content string")
    kept, excluded = cleaning.split_rows(df)
    assert kept.count() == 1
    assert {r.exclude_reason for r in excluded.collect()} == {"punctuation_only", "null_or_empty"}
    assert kept.count() + excluded.count() == df.count()


def test_clean_text(spark):
    df = spark.createDataFrame([("Hi &amp;lt; &lt;b&gt;X&#39;&#x41; <i>y</i>  http://u.v/w?x www.z.com End",)], "t string")
    assert df.select(text.clean_text("t")).first()[0] == "hi &lt; x'a y end"
    assert df.select(text.clean_text("t", every_entity=True)).first()[0] == "hi &lt; x'a y end"


def test_label_cuts(spark):
    df = spark.createDataFrame([(0.2,), (-0.2,), (0.1999,), (0.0,)], "compound double")
    assert [r[0] for r in df.select(sentiment.label("compound")).collect()] == ["positive", "negative", "neutral", "neutral"]
    assert windows.gray_zone(df).count() == 4


def test_sentiment_rules(spark):
    texts = ["good", "very good", "not good", "bad but good", "good!", "the game", "not very good", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, p string")
    got = [r.compound for r in sentiment.add_sentiment(df, "p").orderBy("id").collect()]

    def score(s):
        return round(s / (s * s + 15) ** 0.5, 4)

    assert got == [score(1.9), score(1.9 + 0.293), score(-0.74 * 1.9), score(-2.5 * 0.5 + 1.9 * 1.5), score(1.9 + 0.292),
                   0.0, score((1.9 + 0.293) * -0.74), 0.0]


def test_relational_scoring_agrees(spark):
    texts = ["really not a good day", "so bad, but never terrible!!", "love love hate", "", "nothing here??", "don't like it"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, p string")
    cols = ["id", "compound", "pos", "neu", "neg"]
    lex = sentiment.default_lexicon(spark)
    a = sentiment.add_sentiment(df, "p").select(*cols).orderBy("id").collect()
    b = sentiment.add_sentiment_relational(df, ["id"], "p", lex).select(*cols).orderBy("id").collect()
    c = sentiment.add_sentiment(df, "p", lexicon=lex).select(*cols).orderBy("id").collect()
    assert a == b == c


def test_feature_columns(spark):
    df = spark.createDataFrame([("Great game!", True), ("Terrible lag.", False)], "review_content string, voted_up boolean")
    out = features.add_text_features(df)
    out = out.withColumns(text.char_and_word_stats("review_content_processed") | text.readability("review_content_processed"))
    assert {"compound", "sentiment_label", "char_count", "word_count", "avg_word_length", "flesch_reading_ease",
            "review_content_processed"} <= set(out.columns)
    assert [r.sentiment_label for r in out.collect()] == ["positive", "negative"]


def test_disagreement(spark):
    df = spark.createDataFrame([(False, 0.65), (True, -0.5), (True, 0.7)], "voted_up boolean, compound double")
    row = windows.disagreement_stats(df.withColumn("g", F.lit(1)), ["g"]).first()
    assert (row.n_disagreements, row.disagreement_pct) == (2, 0.6667)


def updates(spark, n=1):
    return spark.createDataFrame(
        [("730", f"u{i}", dt.datetime(2024, 3, 20)) for i in range(n)], "appid string, update_id string, update_ts timestamp"
    ).withColumns({"pre_days": F.lit(7), "post_days": F.lit(7)})


def test_window_edges(spark):
    times = ["2024-03-12 23:59:59", "2024-03-13 00:00:00", "2024-03-19 23:59:59", UTC, "2024-03-27 00:00:00", "2024-03-27 00:00:01"]
    df = spark.createDataFrame([("730", str(i), t) for i, t in enumerate(times)], "appid string, review_id string, ts string")
    out = windows.split_windows(df.withColumn("ts", F.col("ts").cast("timestamp")), updates(spark))
    assert {r.review_id: r.window for r in out.collect()} == {"1": "pre", "2": "pre", "3": "post", "4": "post"}


def test_empty_stats(spark):
    empty = spark.createDataFrame([], "appid string, update_id string, window string, compound double, sentiment_label string")
    row = aggregates.window_stats(empty, updates(spark)).first()
    assert (row.pre_n, row.post_n, row.post_mean, row.sentiment_delta) == (0, 0, 0.0, 0.0)


def signal_rows(spark, pre_n, post_n, pre_neg, post_neg, comment_neg=None):
    stats = spark.createDataFrame(
        [("730", "u0", pre_n, post_n, pre_neg, post_neg, round(post_neg - pre_neg, 4))],
        "appid string, update_id string, pre_n bigint, post_n bigint, pre_negative double, post_negative double, sentiment_delta double")
    comm = None
    if comment_neg is not None:
        comm = spark.createDataFrame([("730", "u0", comment_neg, 100)], "appid string, update_id string, negative_pct double, n_comments bigint")
    return {r.rule: (r.severity, r.value) for r in risk.risk_signals(risk.add_signals(stats, comm)).collect()}


@pytest.mark.parametrize("delta, expected", [
    (0.15, None), (0.16, "MEDIUM"), (0.25, "MEDIUM"), (0.26, "HIGH"), (0.40, "HIGH"), (0.41, "CRITICAL")])
def test_r1(spark, delta, expected):
    got = signal_rows(spark, 10, 10, 0.1, 0.1 + delta).get("R1")
    assert (got[0] if got else None) == expected


@pytest.mark.parametrize("neg, expected", [(0.60, None), (0.61, "HIGH"), (0.7499, "HIGH"), (0.75, "CRITICAL")])
def test_r2(spark, neg, expected):
    got = signal_rows(spark, 10, 10, 0.6, neg).get("R2")
    assert (got[0] if got else None) == expected


def test_r3_to_r5(spark):
    assert "R3" not in signal_rows(spark, 10, 30, 0.1, 0.1)
    assert signal_rows(spark, 10, 31, 0.1, 0.1)["R3"] == ("MEDIUM", 3.1)
    assert "R3" not in signal_rows(spark, 0, 31, 0.0, 0.1)
    assert signal_rows(spark, 100, 0, 0.2, 0.0, 0.65) == {"R4": ("HIGH", 0.65)}
    assert signal_rows(spark, 10, 10, 0.2, 0.2, 0.71)["R4"][0] == "CRITICAL"
    assert "R5" not in signal_rows(spark, 10, 10, 0.25, 0.25, 0.45)
    assert signal_rows(spark, 10, 10, 0.2, 0.2, 0.45)["R5"] == ("MEDIUM", 0.25)


def test_distribution_summary(spark):
    rows = [("L", False), ("L", True), ("L", False), ("W", True), ("a much longer text about the game", False)]
    df = spark.createDataFrame(rows, "review_content string, voted_up boolean").withColumns({"g": F.lit(1), "compound": F.lit(0.5)})
    s = aggregates.distribution_summary(df, ["g"]).first().summary
    assert "Of 5 reviews, 40% (2) recommend" in s and "60% (3) advise" in s and '3 x "L", 1 x "W"' in s


def test_prefilter(spark):
    rows = [("gg", 1), (" great patch ", 2), ("great patch", 3), ("THIS comment is awaiting analysis x", 4), (None, 5), ("nope.", 6)]
    df = spark.createDataFrame([("730", "c", str(p), c, p) for c, p in rows],
                               "appid string, forum_topic_id string, comment_id string, content string, position int")
    out = comments.prefilter(df, ["appid"]).orderBy("position").collect()
    assert [(r.content, r.position) for r in out] == [("great patch", 2), ("nope.", 6)]
    n = comments.prefilter_counts(df, ["appid"]).first()
    assert (n.n_raw, n.n_kept, n.n_removed) == (6, 2, 4)


def test_failed_chunk_keeps_its_size(spark):
    df = spark.createDataFrame([("730", str(i), f"text number {i}", i) for i in range(120)],
                               "appid string, comment_id string, content string, position int")

    def analyse(texts):
        if len(texts) == 20:
            raise RuntimeError("no answer")
        return {"sentiment": {"positive": len(texts)}, "themes": [{"label": "x"}], "quotes": []}

    chunked = comments.add_chunks(df, ["appid"])
    row = aggregates.comment_stats(comments.analyse_chunks(chunked, ["appid"], analyse), ["appid"]).first()
    assert (row.n_comments, row.positive_count, row.n_chunks, row.n_analysed, row.positive_pct) == (120, 100, 3, 2, 0.8333)


def test_patch_note_words(spark):
    rows = [("Fixes for maps", None), ("patch: one", None), ("Big Update", None), ("Sale", ["PatchNotes"]), ("Sale", ["news"])]
    df = spark.createDataFrame(rows, "title string, tags array<string>")
    assert [(r.title, r.tags) for r in windows.patch_notes(df).collect()] == [("Big Update", None), ("Sale", ["PatchNotes"])]


def test_comment_time(spark):
    raw = ["Nov 7, 2024 @ 11:06pm", "nov 7, 2024 @ 12:06AM", "2024 年 11 月 7 日 下午 11:06", "7 Nov 2024 @ 23:06", None]
    df = spark.createDataFrame([(r,) for r in raw], "t string")
    got = [str(r[0]) if r[0] else None for r in df.select(text.parse_comment_time("t").cast("string")).collect()]
    assert got == ["2024-11-07 23:06:00", "2024-11-07 00:06:00", None, None, None]


def test_levels():
    assert config.FIXED_CUTS.critical == 2.5 and config.MIXED_CUTS.high == 2.0
