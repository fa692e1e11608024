"""Steps that were made cheaper must give what the plain ones give."""

from pyspark.sql import functions as F

from patchpulse import config
from patchpulse.functions import sentiment, text
from patchpulse.operators import models


def test_keywords_are_found_as_by_the_pattern_alone(spark):
    # every character that equals an ASCII one where case is ignored lower-cases to it or is named
    letters = spark.range(128, 0x110000).where("id < 55296 OR id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    found = letters.where(F.col("c").rlike(r"(?iU)^[\x00-\x7f]$")).collect()
    assert {r.c for r in found} <= set(text.FOLDED)
    rows = [("the LAG is bad",), ("flags",), ("craſh!",), ("Keyboard lag",), (None,), ("",), ("crashé",), ("Crıtİc",), ("fps-drop, P2W",), ("café naïve",)]
    df = spark.createDataFrame(rows, "t string")
    lists = [*[list(k) for _, k in config.TOPIC_KEYWORDS], config.TOXIC_WORDS, config.BUG_WORDS, ("keyboard", "critic"), ("naïve",), ("two words",)]
    for words in lists:
        pairs = df.select(text.holds_keyword("t", words).alias("got"), F.col("t").rlike(text.keyword_pattern(words)).alias("want")).collect()
        assert [p.got for p in pairs] == [p.want for p in pairs]
    plan = df.select(text.mentions("t", ("lag",)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan  # texts without the word do not reach the pattern


def test_relational_sentiment_shuffles_lexicon_words_only(spark, monkeypatch):
    rows = [("a", "not very good but awful!!"), ("b", "plain words of no list"), ("c", ""), ("d", None), ("e", "good good? bad??"), ("f", "great " * 50)]
    df = spark.createDataFrame(rows, "id string, p string")
    cols = ["id", "compound", "pos", "neu", "neg", "sentiment_label"]
    want = sorted(sentiment.add_sentiment(df, "p").select(*cols).collect())
    lexicon = sentiment.default_lexicon(spark)
    out = sentiment.add_sentiment_relational(df, ["id"], "p", lexicon).select(*cols)
    assert sorted(out.collect()) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (word" in plan and "Join LeftOuter, (word" not in plan  # words without an entry end before the shuffle
    monkeypatch.setattr(sentiment, "is_small", lambda *a: False)  # a lexicon that is not broadcast whole
    assert sorted(sentiment.add_sentiment_relational(df, ["id"], "p", lexicon).select(*cols).collect()) == want


def test_tfidf_stats_shuffle_no_words_of_rows(spark):
    df = spark.createDataFrame([("1", "red red blue x"), ("2", "blue green, green! GREEN"), ("3", ""), ("4", None)], "review_id string, t string")
    got = {r.review_id: r for r in models.tfidf_stats(df, "t", max_features=2).collect()}
    assert set(got) == {"1", "2", "3", "4"} and [got[i].tfidf_nonzero_count for i in "1234"] == [1, 2, 0, 0]
    assert got["1"].tfidf_max == 1.0 and got["3"].tfidf_max == got["4"].tfidf_std == 0.0  # blue (2 rows) and green are the vocabulary
    plan = models.tfidf_stats(df, "t", max_features=2)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate [review_id" in p and ", term" in p.split("]")[0] for p in plan.splitlines())
