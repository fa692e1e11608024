"""Topics under stable ids: the assignment equals all permutations, planted topics keep their numbers."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from patchpulse.operators import topic_drift


def test_assignment_equals_all_permutations():
    rng = np.random.default_rng(2)
    for trial in range(150):
        k = int(rng.integers(1, 7))
        gain = rng.random((k, k)) if trial % 3 else rng.integers(0, 3, (k, k)).astype(float)  # ties too
        got = topic_drift.best_assignment(gain)
        assert sorted(got) == list(range(k))
        best = max(sum(gain[i, p[i]] for i in range(k)) for p in itertools.permutations(range(k)))
        assert abs(gain[np.arange(k), got].sum() - best) < 1e-9


def test_planted_topics_keep_their_ids(spark):
    themes = (["lag", "fps", "stutter", "drops"], ["price", "store", "shop", "money"], ["story", "music", "art", "voice"])
    rng = np.random.default_rng(4)
    rows = [(week, " ".join(rng.choice(themes[(i + week) % 3], 12))) for week in range(3) for i in range(90)]
    rows += [(None, "lag lag"), (1, None), (1, ""), (7, "")]
    df = spark.createDataFrame(rows, "week int, t string")
    got = topic_drift.topics_over_time(df, "t", F.col("week"), n_topics=3, iterations=30, n_words=4).collect()
    assert {r.period for r in got} == {0, 1, 2} and sum(r.n_rows for r in got) == 270
    for topic in range(3):
        mine = {r.period: r for r in got if r.topic == topic}
        assert set(mine) == {0, 1, 2} and mine[0].similarity is None
        assert len({frozenset(r.words) for r in mine.values()}) == 1
        assert mine[1].similarity > 0.95 and mine[2].similarity > 0.95
    assert topic_drift.topics_over_time(df.limit(0), "t", F.col("week")).count() == 0
