"""Properties and brute-force comparisons on small inputs."""

import collections
import datetime as dt
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from patchpulse.functions import text
from patchpulse.operators import anomaly, comments, coordinated, joins, models, timeline
from patchpulse.operators.quantiles import exact_quantiles
from patchpulse.session import fresh_path
from patchpulse.sources import announcements, reviews

START = dt.datetime(2024, 1, 1)


def events(spark, n=400, apps=2, seed=3, skew=0.9):
    rng = np.random.default_rng(seed)
    rows = [
        ("hot" if rng.random() < skew else f"a{rng.integers(apps)}", i,
         START + dt.timedelta(seconds=int(rng.integers(0, 10 * 86400))), float(round(rng.uniform(-1, 1), 2)))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "appid string, event_id bigint, ts timestamp, score double").repartition(4), rows


def test_rolling_equals_brute_force(spark):
    df, rows = events(spark)
    got = {r.event_id: r for r in timeline.rolling_features(df).collect()}
    for app, i, ts, _ in rows:
        for w in (24, 48, 72):
            inside = [s for a, _, t, s in rows if a == app and ts - dt.timedelta(hours=w) < t <= ts]
            r = got[i]
            assert r[f"comment_rate_{w}h"] == len(inside)
            assert math.isclose(r[f"sentiment_rolling_mean_{w}h"], np.mean(inside), abs_tol=1e-9)
            assert r[f"sentiment_rolling_min_{w}h"] == min(inside) and r[f"sentiment_rolling_max_{w}h"] == max(inside)
            if len(inside) > 1:
                assert math.isclose(r[f"sentiment_rolling_std_{w}h"], np.std(inside, ddof=1), abs_tol=1e-6)
            else:
                assert r[f"sentiment_rolling_std_{w}h"] is None


def test_finer_buckets_change_nothing(spark):
    df, _ = events(spark, n=200)
    a, b = (timeline.rolling_features(df, buckets_per_hour=n).drop("_hour").toPandas().sort_values("event_id").reset_index(drop=True)
            for n in (1, 4))
    pd.testing.assert_frame_equal(a, b, check_exact=False, atol=1e-9)


def test_trends_do_not_depend_on_partitioning(spark):
    df, rows = events(spark)
    outs = []
    for n in (1, 7):
        out = timeline.trend_features(timeline.rolling_features(df.repartition(n))).drop("_hour")
        pdf = out.toPandas().sort_values("event_id").reset_index(drop=True)
        outs.append(pdf[sorted(pdf.columns)])
    pd.testing.assert_frame_equal(outs[0], outs[1], check_exact=False, atol=1e-9)
    by_app = collections.defaultdict(list)
    mean = dict(zip(outs[0].event_id, outs[0].sentiment_rolling_mean_24h))
    diff = dict(zip(outs[0].event_id, outs[0].sentiment_diff_24h))
    for app, i, ts, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        by_app[app].append(i)
    for ids in by_app.values():
        for a, b in zip(ids, ids[1:]):
            assert math.isclose(diff[b], mean[b] - mean[a], abs_tol=1e-9)


def test_as_of(spark):
    df, rows = events(spark, n=200)
    news = spark.createDataFrame([("hot", START + dt.timedelta(days=d, hours=5)) for d in (1, 1, 6)], "appid string, published_at timestamp")
    out = {r.event_id: r for r in timeline.align_to_latest_patch(df, news).collect()}
    assert len(out) == 200
    for app, i, ts, _ in rows:
        prior = [START + dt.timedelta(days=d, hours=5) for d in (1, 6) if app == "hot" and START + dt.timedelta(days=d, hours=5) <= ts]
        assert (out[i].latest_news_date is None) == (not prior)
        if prior:
            assert math.isclose(out[i].hours_since_latest_news, (ts - max(prior)).total_seconds() / 3600, abs_tol=1e-9)


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(size=500), np.zeros(300), [1e6]])
    df = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(vals)], "x double, g int")
    row = exact_quantiles(df, "x", (0.05, 0.5, 0.95, 1.0)).first()
    assert np.allclose([row.p5, row.p50, row.p95, row.p100], np.quantile(vals, [0.05, 0.5, 0.95, 1.0]))
    per = {r.g: r.p50 for r in exact_quantiles(df, "x", (0.5,), ("g",)).collect()}
    assert np.allclose([per[0], per[1]], [np.median(vals[0::2]), np.median(vals[1::2])])


def test_elliptic_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 2]])
    x[5] = 9
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double")
    got = {r.id: r for r in anomaly.detect_elliptic(df, ["a", "b", "c"]).collect()}
    z = (x - x.mean(0)) / x.std(0)
    d = np.einsum("ij,jk,ik->i", z, np.linalg.pinv(z.T @ z / len(z)), z)
    assert np.allclose([got[i].ml_anomaly_score for i in range(200)], d)
    assert got[5].ml_anomaly == 1 and sum(r.ml_anomaly for r in got.values()) == 10


def test_isolation_finds_the_outlier(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    x[7] = 8
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double")
    got = anomaly.detect_isolation(df, ["a", "b"], "id", n_trees=30, sample=64).orderBy(F.desc("ml_anomaly_score")).first()
    assert got.id == 7


def brute_groups(rows, threshold, min_size, max_terms=500):
    docs = [[t for t in re.split(r"\W+", x.lower()) if len(t) >= 2] for _, x in rows]
    total = collections.Counter(t for d in docs for t in d)
    df = collections.Counter(t for d in docs for t in set(d))
    vocab = {t: i for i, t in enumerate(sorted(total, key=lambda t: (-total[t], t))[:max_terms])}
    m = np.zeros((len(docs), len(vocab)))
    for i, d in enumerate(docs):
        for t in d:
            if t in vocab:
                m[i, vocab[t]] += 1
    m *= np.array([math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in vocab])
    m /= np.linalg.norm(m, axis=1)[:, None]
    near, seen, out = (m @ m.T) >= threshold - 1e-9, set(), {}
    for i in range(len(docs)):
        if i in seen:
            continue
        todo, comp = [i], {i}
        while todo:
            for y in map(int, np.flatnonzero(near[todo.pop()])):
                if y not in comp:
                    comp.add(y)
                    todo.append(y)
        seen |= comp
        if len(comp) >= min_size:
            ix = sorted(comp)
            sims = (m[ix] @ m[ix].T)[np.triu_indices(len(ix), 1)]
            out[frozenset(rows[j][0] for j in ix)] = sims.mean()
    return out


def test_coordinated_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(80)]
    base = [list(rng.choice(words, 12)) for _ in range(4)]
    rows = []
    for i in range(120):
        t = list(base[i % 4]) if i < 90 else list(rng.choice(words, 12))
        if i % 3 == 1:
            t[int(rng.integers(12))] = str(rng.choice(words))
        if i % 3 == 2:
            for _ in range(2):
                t[int(rng.integers(12))] = str(rng.choice(words))
        rows.append((f"r{i}", " ".join(t)))
    df = spark.createDataFrame([("x", i, t, START) for i, t in rows], "appid string, review_id string, t string, ts timestamp")
    flagged, groups = coordinated.detect_coordinated(df, "review_id", "t", min_size=10)
    got = collections.defaultdict(set)
    for r in flagged.where("is_coordinated = 1").collect():
        got[r.group_id].add(r.review_id)
    want = brute_groups(rows, 0.85, 10)
    assert set(map(frozenset, got.values())) == set(want)
    sims = {frozenset(got[r.group_id]): r.avg_similarity for r in groups.collect()}
    assert all(math.isclose(sims[k], v, abs_tol=1e-9) for k, v in want.items())
    assert flagged.count() == 120


def test_composite_alerts_of_coordinated_reviews(spark, monkeypatch):
    from patchpulse.catalog import risk_queries

    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(80)]
    copied, few = list(rng.choice(words, 12)), list(rng.choice(words, 12))
    rows = [(i, " ".join(copied if i < 14 else few if i < 23 else rng.choice(words, 12))) for i in range(60)]
    for i in range(0, 14, 2):
        rows[i] = (i, rows[i][1] + " " + str(rng.choice(words)))
    reviews = spark.createDataFrame([("x", i, START, t) for i, t in rows] + [("y", 100, START, None)], "appid string, doc_id bigint, ts timestamp, review_content string")
    columns = "appid string, doc_id bigint, risk_label_weak int, trend_alert int, is_statistical_anomaly int, ml_anomaly int"
    causes = spark.createDataFrame([("x", i, int(i == 50), int(i == 51), 0, 0) for i, _ in rows] + [("y", 100, 0, 0, 0, 0)], columns)
    monkeypatch.setattr(risk_queries, "ensemble_rows", lambda *_: causes)
    monkeypatch.setattr(risk_queries.anomaly, "trend_alerts", lambda df: df)
    monkeypatch.setattr(risk_queries.V, "reviews", lambda *_: reviews)
    got = {r.appid: (r.n_rows, r.n_alerts) for r in risk_queries.composite_alerts(spark, "").collect()}
    crowds = brute_groups([(i, t) for i, t in rows], 0.85, 10)
    alerts = {50, 51}.union(*crowds)
    assert alerts >= set(range(14)) and not alerts & set(range(14, 23))
    assert got == {"x": (60, len(alerts)), "y": (1, 0)}


def test_ingest_twice_is_ingest_once(spark):
    rows = [("730", f"r{i % 30}", f"text {i % 30}", START + dt.timedelta(minutes=i % 30)) for i in range(90)]
    df = spark.createDataFrame(rows, "appid string, review_id string, review_content string, ts timestamp")
    path = fresh_path(spark, "store")
    assert reviews.ingest_reviews(df, path) == 30
    assert reviews.ingest_reviews(df, path) == 0
    stored = reviews.read_store(spark, path)
    assert stored.count() == 30 and stored.first().language == "english"


def test_running_position(spark):
    df = spark.createDataFrame([("a", i * 7 % 100, str(i)) for i in range(100)], "k string, position int, comment_id string")
    out = comments.running_position(df, ["k"], F.floor(F.col("position") / 9), comments.ORDER, "pos").collect()
    assert all(r.pos == r.position + 1 for r in out)


def test_comment_blocks(spark):
    page = """<div class="commentthread_comment responsive" id="c1"><a class="commentthread_author_link"><bdi>Ann</bdi></a>
    <span class="commentthread_comment_timestamp"> Nov 7, 2024 @ 11:06pm </span>
    <div class="commentthread_comment_text"> Nice <b>patch</b> &amp; more<br> </div><span class="upvote_count">+12</span></div>
    <div class="commentthread_comment" id="c2"><div class="commentthread_comment_text">second</div></div>"""
    out = announcements.extract_comments(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")).collect()
    assert [(r.comment_id, r.author, r.content, r.upvotes, str(r.published_at)) for r in out] == [
        ("c1", "Ann", "Nicepatch& more", 12, "2024-11-07 23:06:00"), ("c2", "", "second", 0, "None")]


def test_evaluation_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    y = (rng.random(300) < 0.3).astype(int)
    s = np.round(0.3 * y + rng.random(300), 3)
    df = spark.createDataFrame(list(zip(map(float, s), map(int, y))), "s double, y int")
    got = models.evaluate(df, "s", "y").first()
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    f1 = max(2 * y[s >= c].sum() / ((s >= c).sum() + y.sum()) for c in np.unique(s))
    assert math.isclose(got.roc_auc, auc) and math.isclose(got.f1, f1)
    assert got.tp + got.fp + got.fn + got.tn == 300


def test_nearest_event_with_comments_however_far(spark):
    up = spark.createDataFrame([("a", "u", START)], "appid string, update_id string, update_ts timestamp")
    ev = spark.createDataFrame([("a", f"g{i}", f"t{i}" if i != 3 else "", START + dt.timedelta(hours=i)) for i in range(1, 30)],
                               "appid string, gid string, forum_topic_id string, event_ts timestamp").withColumn("event_name", F.lit("x"))
    topics = spark.createDataFrame([("a", "t25"), ("a", "t7")], "appid string, forum_topic_id string")
    assert joins.nearest_with_comments(up, ev, topics).first().gid == "g7"
    assert joins.nearest_with_comments(up, ev, topics.where("forum_topic_id = 't25'")).first().gid == "g25"
    assert joins.nearest_with_comments(up, ev, topics.where("forum_topic_id = 'none'")).count() == 0


def test_coordinated_reads_its_rows_once_and_spills_nothing_by_row(spark):
    rows = [("x", i, f"word{i % 7} more{i % 3} text {'again ' * (i % 4)}", START) for i in range(40)] + [("x", 99, "!", START), ("y", 100, "word1 text", START)]
    df = spark.createDataFrame(rows, "appid string, doc_id int, t string, ts timestamp")
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    marks, groups = coordinated.coordinated_marks(df.mapInArrow(read, df.schema), "doc_id", "t", min_size=10)
    marks.count()
    assert seen.value == len(rows)  # texts were read, joined and shuffled anew for every pass
    counts = text.word_counts(df, "t", "_tf").withColumn("_n", F.lit(42))
    vec = coordinated.vectors(counts, ["appid"], "doc_id", 500)
    plan = vec._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and vec.count() == 41  # vectors are made inside the row, no aggregate by row can spill


def test_joint_vocabulary_counts_no_terms_with_rare_parts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = ["so it is " * int(rng.integers(1, 4)) + " ".join(f"w{int(x)}" for x in rng.integers(0, 400, 60)) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    counted, save = [], models.save_table

    def saved(table, name):
        out = save(table, name)
        if name == "totals":
            counted.append(out.count())
        return out

    monkeypatch.setattr(models, "save_table", saved)
    got = [(r.term, r.total, r.df, r.rank) for r in models.joint_vocabulary(df, "t", 20, 3, 2, 1.0).orderBy("rank").collect()]
    total, in_rows = collections.Counter(), collections.Counter()
    for t in texts:
        w = t.split()
        grams = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
        total.update(grams)
        in_rows.update(set(grams))
    best = sorted((g for g in total if in_rows[g] >= 2), key=lambda g: (-total[g], g))[:20]
    assert got == [(g, total[g], in_rows[g], i + 1) for i, g in enumerate(best)]
    assert counted[1] < 100 and counted[2] < 20  # of thousands of runs of two and three words
