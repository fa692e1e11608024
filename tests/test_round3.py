"""Change points, robust covariance, stateful stream trends, phrases and capitals in sentiment."""

import datetime as dt
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchpulse.functions import sentiment, text
from patchpulse.operators import anomaly, changes, robust
from patchpulse.session import fresh_path, spread
from patchpulse.streaming import jobs, trends

START = dt.datetime(2024, 3, 4)


def quadratic(counts, penalty, shortest):
    """Least cost of all segmentations, every start tried."""
    cost, n = changes.poisson_cost(counts), len(counts)
    best = [-penalty] + [math.inf] * n
    for end in range(1, n + 1):
        for start in range(0, end - shortest + 1):
            best[end] = min(best[end], best[start] + float(cost(np.array([start]), end)[0]) + penalty)
    return best[n]


@pytest.mark.parametrize("shortest", [1, 3, 6])
def test_pruned_segmentation_has_the_least_cost(shortest):
    rng = np.random.default_rng(shortest)
    for _ in range(60):
        counts = np.concatenate([rng.poisson(rng.choice([0.3, 2, 9, 30]), rng.integers(2, 25)) for _ in range(rng.integers(1, 5))])
        penalty = float(rng.choice([0.5, 4, 12]))
        starts = changes.segment_starts(counts, penalty, shortest)
        edges = [0, *starts, len(counts)]
        assert all(b - a >= shortest for a, b in itertools.pairwise(edges)) or not starts
        if len(counts) >= shortest:
            cost = changes.poisson_cost(counts)
            total = sum(float(cost(np.array([a]), b)[0]) for a, b in itertools.pairwise(edges)) + penalty * len(starts)
            assert total == pytest.approx(quadratic(counts, penalty, shortest), abs=1e-8)


def test_shifts_and_spikes_are_told_apart(spark):
    rng = np.random.default_rng(7)
    series = {"shift": np.concatenate([rng.poisson(5, 200), rng.poisson(20, 150)]), "calm": rng.poisson(5, 300), "spike": rng.poisson(5, 300), "quiet": np.concatenate([rng.poisson(12, 100), np.zeros(80, int), [1]])}
    series["spike"][120] = 90
    rows = [(app, START + dt.timedelta(hours=h, minutes=int(m))) for app, c in series.items() for h, n in enumerate(c) for m in range(min(n, 59) if n < 60 else 59)]
    rows += [("spike", START + dt.timedelta(hours=120))] * 40 + [(None, START), ("calm", None)]
    df = spark.createDataFrame(rows, "appid string, ts timestamp")
    got = changes.detect_changes(df).collect()
    assert not [r for r in got if r.appid == "calm"]
    at = {(r.appid, r.kind): round((r.hour - START).total_seconds() / 3600) for r in got if r.kind == "shift"}
    assert set(at) == {("shift", "shift"), ("quiet", "shift")} and abs(at["shift", "shift"] - 200) <= 1 and abs(at["quiet", "shift"] - 100) <= 1
    assert [(r.appid, round((r.hour - START).total_seconds() / 3600), r.rate_before) for r in got if r.kind == "spike" and r.appid != "quiet"] == [("spike", 120, None)]
    one = next(r for r in got if r.appid == "shift")
    assert abs(one.rate_before - 5) < 1 and abs(one.rate_after - 20) < 2
    assert changes.detect_changes(df.limit(0)).count() == 0


def test_chi_square_quantiles():
    assert robust.chi2_quantile(0.5, 2) == pytest.approx(2 * math.log(2), abs=1e-9)
    assert robust.chi2_quantile(0.975, 3) == pytest.approx(9.348403604, abs=1e-6)
    assert robust.consistency(0.999999, 3) == pytest.approx(1, abs=1e-3)


def brute_mcd(data, share, tries=400):
    """Concentration from many random starts, in numpy."""
    rng, (n, k), best = np.random.default_rng(1), data.shape, (math.inf, None, None)
    for _ in range(tries):
        part = data[rng.choice(n, k + 2, replace=False)]
        centre, cov = part.mean(axis=0), np.cov(part.T, bias=True)
        for _ in range(40):
            d = np.einsum("ij,jk,ik->i", data - centre, np.linalg.pinv(cov), data - centre)
            near = data[d <= np.sort(d)[math.ceil(share * n) - 1]]
            centre, cov = near.mean(axis=0), np.cov(near.T, bias=True)
        det = np.linalg.slogdet(cov)[1]
        if det < best[0]:
            best = (det, centre, cov)
    return best


def test_minimum_covariance_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    mix = np.array([[1, 0.6, 0], [0, 1, 0.3], [0, 0, 0.5]])
    data = rng.normal(size=(200, 3)) @ mix
    data[:40] = rng.normal(size=(40, 3)) * 0.4 + [9, -7, 8]  # a fifth of the rows lies elsewhere
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)] + [(999, None, 0.0, 0.0)], "id int, a double, b double, c double")
    got = robust.minimum_covariance(df, ["a", "b", "c"], share=0.75)
    det, centre, cov = brute_mcd(data, 0.75)
    assert got.log_det == pytest.approx(det, abs=1e-6)
    assert np.allclose(got.centre, centre, atol=1e-6) and np.allclose(got.covariance, cov * robust.consistency(0.75, 3), atol=1e-6)
    assert np.abs(got.centre).max() < 0.4 and np.abs(data.mean(axis=0)).max() > 1.2
    flagged = {r.id for r in anomaly.detect_robust(df, ["a", "b", "c"], 0.2).where("ml_anomaly = 1").collect()}
    assert flagged >= set(range(40)) - {0} and len(flagged) <= 41


def stream_rows():
    rng = np.random.default_rng(5)
    rows = []
    for app, rate in (("a", 3), ("b", 1)):
        for h in range(24 * 22):
            n = 40 if (app, h) == ("a", 24 * 20 + 5) else rng.poisson(rate)
            rows += [(app, START + dt.timedelta(hours=h, minutes=int(m)), float(rng.integers(-9, 10)) / 10) for m in rng.integers(0, 60, n)]
    return sorted(rows, key=lambda r: r[1])


def expected_trends(rows, last):
    out, by = {}, {}
    for app, ts, score in rows:
        by.setdefault((app, int((ts - START).total_seconds() // 3600)), []).append(score)
    for (app, h), scores in by.items():
        if h + 1 > last:
            continue
        first = min(x for a, x in by if a == app)
        recent = [s for x in range(h - 23, h + 1) for s in by.get((app, x), [])]
        weeks = (h - first) // 168
        past = [0.5 ** k * len(by.get((app, h - 168 * k), [])) for k in range(1, h // 168 + 1)]
        base = sum(past) / sum(0.5 ** k for k in range(1, weeks + 1)) if weeks else None
        out[app, h] = (len(scores), len(recent), sum(recent) / len(recent), sum(s < 0 for s in recent) / len(recent), base, bool(weeks and len(scores) > 3 * base))
    return out


def test_stream_trends_over_batches_restart_and_late_rows(spark):
    rows = stream_rows()
    landing, out, state = fresh_path(spark, "landing"), fresh_path(spark, "out"), fresh_path(spark, "state")
    schema = "appid string, ts timestamp, score double"
    cut = [len(rows) * k // 4 for k in range(5)]

    def land(part):
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(landing)

    def run():
        stream = trends.hourly_trends(jobs.read_stream(spark, landing, schema, files_per_batch=2))
        stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    for a, b in zip(cut, cut[1:3]):
        land(rows[a:b])
    run()  # stops here and goes on from its checkpoint
    for a, b in zip(cut[2:], cut[3:]):
        land(rows[a:b])
    land([("a", START, 1.0), ("new", START, 1.0)])  # three weeks late: counts for nothing
    run()
    newest = max(r[1] for r in rows) - dt.timedelta(hours=1)
    want = expected_trends(rows, (newest - START).total_seconds() / 3600)
    got = {(r.appid, round((r.hour - START).total_seconds() / 3600)): tuple(r)[2:] for r in spark.read.parquet(out).collect()}
    assert len(got) == spark.read.parquet(out).count() and set(got) == set(want)
    assert all(g == pytest.approx(w, abs=1e-9) for g, w in ((got[k], want[k]) for k in want))
    assert [k for k, v in got.items() if v[-1] and k[0] == "a" and v[0] == 40] == [("a", 24 * 20 + 5)]


def test_spread_leaves_rows_and_wide_scans_alone(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    one = df.coalesce(1)
    assert spread(one, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert Counter(spread(one, "id").collect()) == Counter(df.collect())
    wide = df.repartition(spark.sparkContext.defaultParallelism)
    assert spread(wide, "id") is wide


def test_sentiment_of_published_sentences(spark):
    from patchpulse.functions import phrases

    words = {"smart": 1.7, "handsome": 2.2, "funny": 1.9, "good": 1.9, "sux": -1.5}
    lexicon = spark.createDataFrame([(w, v, 0.0, 1.0) for w, v in words.items()], "word string, valence double, boost double, negation double")
    lexicon = lexicon.unionByName(sentiment.default_lexicon(spark).where("valence IS NULL"))
    expected = {
        "VADER is smart, handsome, and funny.": 0.8316, "VADER is smart, handsome, and funny!": 0.8439,
        "VADER is very smart, handsome, and funny.": 0.8545, "VADER is VERY SMART, handsome, and FUNNY.": 0.9227,
        "VADER is VERY SMART, handsome, and FUNNY!!!": 0.9342, "VADER is not smart, handsome, nor funny.": -0.7424,
        "The book was good.": 0.4404, "The book was only kind of good.": 0.3832, "Today SUX!": -0.5461, "THE BOOK WAS GOOD": 0.4404, "": 0.0,
    }
    df = spark.createDataFrame([(t,) for t in expected] + [(None,)], "t string")
    got = {r.t: r.compound for r in phrases.add_cased_sentiment(df, "t", lexicon).collect()}
    assert got == expected | {None: 0.0}


def test_phrases_are_longest_first_and_not_read_twice(spark):
    from patchpulse.functions import phrases

    listed = {"a b": (1.0, 0.0), "a b c": (2.0, 0.0), "b c d": (3.0, 0.0), "c d": (4.0, 0.0), "d.e f": (5.0, 0.0)}
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "A", "(b", "c!", "d.e", "f", "dxe", "..."]) for _ in range(rng.randint(0, 14))) for _ in range(300)]

    def brute(t):
        ws, out, i = t.split(), [], 0
        while i < len(ws):
            n = next((k for k in (3, 2) if i + k <= len(ws) and " ".join(ws[i : i + k]).strip(text.PUNCTUATION).lower() in listed), 1)
            w = " ".join(ws[i : i + n])
            bare = w.strip(text.PUNCTUATION)
            out.append(w if len(bare) <= 2 else bare)
            i += n
        return out

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", phrases.phrase_tokens("t", listed).alias("w"), phrases.phrase_tokens("t", {}).alias("p"))
    for r in df.collect():
        assert r.w == brute(r.t)
        assert len(r.p) == len(r.t.split())


def test_joint_vocabulary_equals_brute_force(spark):
    from patchpulse.operators import models

    rng = random.Random(4)
    texts = [" ".join(rng.choice("aa bb cc dd ee x ff".split()) for _ in range(rng.randint(0, 9))) for _ in range(80)] + [None, "aa aa aa", "BB-cc"]
    total, rows = Counter(), Counter()
    for t in texts:
        ws = [w for w in (t or "").lower().replace("-", " ").split() if len(w) >= 2]
        terms = [" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]
        total.update(terms)
        rows.update(set(terms))
    allowed = [t for t in total if 3 <= rows[t] <= 0.6 * len(texts)]
    best = sorted(allowed, key=lambda t: (-total[t], t))[:40]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = models.joint_vocabulary(df, "t", 40, 3, 3, 0.6).orderBy("rank").collect()
    assert [(r.term, r.total, r.df) for r in got] == [(t, total[t], rows[t]) for t in best]
    model = models.tfidf_model(df.fillna(""), "t", 40, 3, 3, 0.6)
    assert model.stages[-2].vocabulary == best
    with pytest.raises(ValueError):
        models.tfidf_model(df.fillna(""), "t", 40, 3, 1000)


def test_boosted_model_reads_text_beside_numbers(spark):
    from patchpulse.operators import models

    rows = [(float(i % 7), "bad crash here" if i % 2 else "good fun here", i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "n double, t string, y int")
    model = models.train_boosted(df, ["n"], "y", iterations=3, content="t")
    top = models.feature_importance(model, df).collect()
    assert len(top) == 1 + 4 + 4 + 2  # the number, words without "here", pairs, triples
    assert sum(r.importance for r in top if r.feature.startswith("text: ")) > 0.9
    assert model.transform(df).where("prediction <> y").count() == 0
