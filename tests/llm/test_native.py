"""Mixing and sharding: DataFrame functions only, right sums, and the same choices as a plain re-computation."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchpulse.llm import mixing, sharding

from .helpers import empty, frame, odd_rows, prose


def documents(spark, n=400):
    rng = random.Random(1)
    rows = odd_rows(rng)
    for i in range(n):
        source = "hot" if rng.random() < 0.4 else f"s{rng.randrange(6)}"
        rows.append((100 + i, prose(rng, rng.randint(1, 300)), rng.choice(("en", "en", "de", "fr")), source))
    rows += [(2000 + i, rows[40][1], "en", f"s{i % 6}") for i in range(12)]
    return frame(spark, rows), rows


def has_python(df):
    return re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_raked_shares_meet_their_targets(spark):
    docs, rows = documents(spark)
    docs, rows = docs.where("source <> 'src0'"), [r for r in rows if len(r) == 4 and r[3]]  # lone cells cannot meet two targets
    out = mixing.mix(docs)
    assert not has_python(out) and not has_python(mixing.draw(docs))
    got = out.collect()
    assert len(got) == len(rows)
    weighted = [r for r in got if r.tokens]
    total = sum(r.tokens * r.ratio for r in weighted)
    assert total == pytest.approx(sum(r.tokens for r in weighted), rel=1e-6)
    for name, power in mixing.TEMPERS.items():
        natural, raked = {}, {}
        for r in weighted:
            natural[r[name]] = natural.get(r[name], 0) + r.tokens
            raked[r[name]] = raked.get(r[name], 0) + r.tokens * r.ratio
        norm = sum(v**power for v in natural.values())
        for value, tokens in natural.items():
            assert raked[value] / total == pytest.approx(tokens**power / norm, rel=2e-2)
    assert max(r.probability for r in weighted) == 1.0
    assert {r.probability for r in got if not r.tokens} <= {1.0}


def test_drawn_documents(spark):
    docs, rows = documents(spark)
    out = mixing.mix(docs).collect()
    chosen = sorted((r.doc_id for r in out if r.sampled), key=lambda x: (x is None, x))
    drawn = mixing.draw(docs)
    assert drawn.columns == docs.columns
    assert sorted((r.doc_id for r in drawn.collect()), key=lambda x: (x is None, x)) == chosen
    expected, spread = sum(r.probability for r in out), sum(r.probability * (1 - r.probability) for r in out) ** 0.5
    assert abs(len(chosen) - expected) < 4 * spread
    assert mixing.mix(empty(spark)).count() == 0 and mixing.draw(empty(spark)).count() == 0


def test_a_rare_cell_does_not_shrink_the_draw(spark, caplog):
    docs, rows = documents(spark)
    stray = frame(spark, [(9000, prose(random.Random(5), 40), "en", "stray")])
    many = docs.where("doc_id >= 100")
    for _ in range(5):
        many = many.unionByName(many.withColumn("doc_id", F.col("doc_id") * 2 + 1))
    out = mixing.mix(many.unionByName(stray)).where("tokens > 0").cache()
    total, drawn = out.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("probability"))).first()
    assert drawn / total == pytest.approx(mixing.KEEP, rel=1e-6)
    assert out.where("source = 'stray'").first().probability == 1.0 and "'stray'" in caplog.text
    assert out.agg(F.max("probability")).first()[0] == 1.0
    got = {r.lang: r.t / drawn for r in out.groupBy("lang").agg(F.sum(F.col("tokens") * F.col("probability")).alias("t")).collect()}
    natural = {r.lang: r.t for r in out.groupBy("lang").agg(F.sum("tokens").alias("t")).collect()}
    norm = sum(v ** mixing.TEMPERS["lang"] for v in natural.values())
    for value, tokens in natural.items():
        assert got[value] == pytest.approx(tokens ** mixing.TEMPERS["lang"] / norm, rel=2e-2)
    assert mixing.draw(many.unionByName(stray)).where("length(trim(text)) > 0").count() == out.where("sampled").count()


def test_calibration_by_bisection(spark):
    rng = random.Random(6)
    rows = [(f"s{i}", "en", "short", rng.randint(1, 10 ** rng.randint(1, 6)), rng.random() * 10 ** rng.randint(0, 3)) for i in range(40)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint, w double")
    got = {r.source: r.p for r in spark.sql(mixing.filled_sql("SELECT * FROM {cells}", "(w * tokens)", "p", 0.7), cells=cells).collect()}
    low, high, total = 0.0, 1e9, sum(r[3] for r in rows)
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if sum(r[3] * min(1, c * r[4]) for r in rows) < 0.7 * total else (low, c)
    assert all(got[r[0]] == pytest.approx(min(1, low * r[4]), rel=1e-6) for r in rows)


def test_mixing_with_a_shuffled_join(spark, monkeypatch):
    docs, _ = documents(spark)
    one = sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=repr) == one


@pytest.mark.parametrize("shards", [1, 2, 5, 24])
def test_shards(spark, shards):
    docs, rows = documents(spark)
    out = sharding.kd_shards(docs, shards=shards)
    assert not has_python(out)
    got = out.collect()
    expected = sorted((d is None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == expected
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.shard for r in got} <= set(range(shards))


def test_shards_are_even_and_keep_copies_together(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(20, 60)), rng.choice(("en", "de")), f"s{min(9, int(rng.expovariate(0.5)))}") for i in range(6000)]
    rows += [(10_000 + i, rows[i // 3][1], "fr", "s1") for i in range(90)] + [(20_000 + i, "the same words again and again " * 8, "en", "s0") for i in range(2500)]
    got = sharding.kd_shards(frame(spark, rows), shards=24).collect()
    size = np.zeros(24)
    for r in got:
        size[r.shard] += r.size
    assert size.max() < 1.03 * size.mean() and size.min() > 0.97 * size.mean()
    texts, places = {r[0]: r[1] for r in rows}, {}
    for r in got:
        places.setdefault(texts[r.doc_id], set()).add(r.shard)
    large = places.pop(rows[-1][1])
    assert len(large) > 1 and all(len(p) == 1 for p in places.values())


def test_cuts_are_weighted_quantiles(spark):
    rng = np.random.default_rng(3)
    x = [(int(a), int(b), int(c), int(t), int(w)) for a, b, c, t, w in zip(rng.integers(0, 9000, 500), rng.integers(0, 50, 500), rng.integers(0, 50, 500), rng.integers(0, 1 << 28, 500), rng.integers(9, 500, 500))]
    rows = spark.createDataFrame([(*r, 0, 5) for r in x], "x0 bigint, x1 bigint, x2 bigint, tie bigint, size bigint, lo int, k int")
    got = sharding.cut(rows).first()
    assert got.dim == 0
    order = sorted(((a << 28) + t, w) for a, _, _, t, w in x)
    left = sum(w for o, w in order if o < got["at"])
    ends = np.cumsum([w for _, w in order])
    assert abs(left - ends[-1] * 2 / 5) == pytest.approx(np.abs(np.append(ends, 0) - ends[-1] * 2 / 5).min())


def test_shards_by_target_bytes_and_empty(spark):
    docs, rows = documents(spark)
    total = sum(len((t or "").encode()) + 8 for _, t, *_ in rows)
    assert {r.shard for r in sharding.kd_shards(docs, target_bytes=total // 3).collect()} <= set(range(4))
    assert sharding.kd_shards(empty(spark), shards=24).count() == 0
