"""The similarity join by residual bounds: equal to brute force at every list size, and its work grows with the postings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchpulse.operators import simjoin

WIDTH = 60


def vectors(rng, n, length, near=0.3):
    out = []
    for _ in range(n):
        if out and rng.random() < near:
            v = out[rng.integers(len(out))].copy()
            v[rng.integers(WIDTH)] += rng.random() * 0.8
        else:
            v = np.zeros(WIDTH)
            v[rng.choice(WIDTH, rng.integers(1, length + 1), replace=False)] = rng.random() + 0.05
        out.append(v / np.linalg.norm(v))
    return out


def frame(spark, blocks, labels=None):
    rows = []
    for name, vs in blocks.items():
        for i, v in enumerate(vs):
            node = f"{name}{i:05d}"
            at = np.nonzero(v)[0]
            rows.append((name, node, labels[node] if labels else node, at.tolist(), v[at].tolist()))
    return spark.createDataFrame(rows, "day string, node string, label string, ord array<int>, u array<double>")


def brute(blocks, threshold, labels=None):
    out = set()
    for name, vs in blocks.items():
        names = [f"{name}{i:05d}" for i in range(len(vs))]
        cos = np.array(vs) @ np.array(vs).T
        for i, j in zip(*np.nonzero(np.triu(cos >= threshold - simjoin.EPS, 1))):
            if not labels or labels[names[i]] != labels[names[j]]:
                out.add((names[i], names[j]))
    return out


@pytest.mark.parametrize("list_nodes, depth, threshold", [(256, 6, 0.85), (6, 7, 0.85), (3, 2, 0.85), (3, 5, 0.6)])
def test_links_equal_brute_force(spark, monkeypatch, list_nodes, depth, threshold):
    monkeypatch.setattr(simjoin, "LIST_NODES", list_nodes)
    monkeypatch.setattr(simjoin, "WHOLE", 1 if list_nodes < 6 else 2)
    monkeypatch.setattr(simjoin, "DEPTH", depth)
    monkeypatch.setattr(simjoin, "STEP", 7)
    rng = np.random.default_rng(list_nodes)
    blocks = {"x": vectors(rng, 90, 12), "y": vectors(rng, 40, 4), "z": vectors(rng, 1, 3)}
    got = simjoin.similarity_links(frame(spark, blocks), ["day"], threshold, WIDTH)
    assert {(r.a, r.b) for r in got.collect()} == brute(blocks, threshold)


def test_linked_crowd_keeps_its_outer_links(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "LIST_NODES", 5)
    monkeypatch.setattr(simjoin, "WHOLE", 1)
    rng = np.random.default_rng(9)
    blocks = {"x": vectors(rng, 70, 5, near=0.8)}
    labels = {f"x{i:05d}": "x00000" if i % 4 else f"x{i:05d}" for i in range(70)}
    got = simjoin.similarity_links(frame(spark, blocks, labels), ["day"], 0.85, WIDTH)
    assert {(r.a, r.b) for r in got.collect()} == brute(blocks, 0.85, labels)


def test_no_rows(spark):
    assert simjoin.similarity_links(frame(spark, {"x": vectors(np.random.default_rng(1), 2, 3)}).limit(0), ["day"], 0.85, WIDTH).count() == 0


def test_twice_the_texts_of_a_day_about_double_the_compared_pairs(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "LIST_NODES", 32)
    rng = np.random.default_rng(3)

    def texts(n):
        out = []
        for _ in range(n):
            v = np.zeros(WIDTH)
            v[rng.choice(WIDTH, 10, replace=False)] = 1
            out.append(v / np.linalg.norm(v))
        return out

    compared = []
    for n in (1500, 3000):
        short, flat = simjoin.candidate_lists(frame(spark, {"x": texts(n)}), ["day"], 0.85)
        pairs = 0
        for lists in short + flat:
            sizes = lists.groupBy("key").agg(F.count("*").alias("n"))
            pairs += sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
        compared.append(pairs)
    assert compared[1] <= 2.4 * compared[0]
    assert compared[1] < 3000 * 2999 / 2


@pytest.mark.parametrize("list_nodes", [256, 12])
def test_forest_joins_what_all_links_join_with_links_below_the_texts_compared(spark, monkeypatch, list_nodes):
    monkeypatch.setattr(simjoin, "LIST_NODES", list_nodes)
    rng = np.random.default_rng(5)
    middle = rng.random((2, WIDTH))
    crowd = [v / np.linalg.norm(v) for i in range(120) for v in [middle[i % 2] + rng.random(WIDTH) * 0.2]]
    blocks = {"x": crowd + vectors(rng, 30, 4)}

    def components(links):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in links:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {x: find(x) for x in list(root)}

    got = simjoin.similarity_links(frame(spark, blocks), ["day"], 0.85, WIDTH, forest=True)
    got = {(r.a, r.b) for r in got.collect()}
    want = brute(blocks, 0.85)
    assert got <= want and components(got) == components(want)
    chunks = -(-150 // (simjoin.CHUNK * list_nodes))
    assert len(got) < 150 * chunks * (chunks + 1) / 2 < len(want)


def test_forest_of_a_crowd_is_a_star_over_all_calls():
    i, j = np.nonzero(np.triu(np.ones((50, 50)), 1))
    forest = simjoin.Forest(50)
    half = len(i) // 2
    few = np.concatenate([forest.joining(i[:half], j[:half]), half + forest.joining(i[half:], j[half:])])
    assert sorted(j[few]) == list(range(1, 50)) and set(i[few]) == {0}
    assert len(forest.joining(i, j)) == 0


def prose(rng, n, words):
    """Texts over few words with weights near to each other, so that the residual bound leaves most of their words open."""
    out = []
    for _ in range(n):
        v = np.zeros(WIDTH)
        v[rng.choice(WIDTH, words, replace=False)] = 1 + rng.random(words) * 0.1
        out.append(v / np.linalg.norm(v))
    return out


def test_a_block_whose_texts_would_stand_in_many_lists_is_not_split(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "LIST_NODES", 4)
    texts = prose(np.random.default_rng(8), 200, 50)  # 14 words may be skipped: with a split each text stands in 14 lists
    short, flat = simjoin.candidate_lists(frame(spark, {"x": texts}), ["day"], 0.85)
    rows = sum(lists.count() for lists in short + flat)
    assert rows == 200


@pytest.mark.parametrize("way", [{}, {"forest": True}, {"stars": True}])
def test_chunks_equal_brute_force_also_near_the_threshold(spark, monkeypatch, way):
    monkeypatch.setattr(simjoin, "LIST_NODES", 20)
    monkeypatch.setattr(simjoin, "CHUNK", 2)
    monkeypatch.setattr(simjoin, "TILE", 16)
    monkeypatch.setattr(simjoin, "FIRST", 4)
    monkeypatch.setattr(simjoin, "COPIES", 0)
    rng = np.random.default_rng(12)

    def beside(v, cosine):  # a unit vector at this cosine, in words that v has not
        out = v * cosine
        free = np.flatnonzero(v == 0)
        out[rng.choice(free)] = np.sqrt(1 - cosine * cosine)
        return out

    texts = prose(rng, 60, 12)
    texts += [beside(v, c) for v in texts[:20] for c in (0.85 + 1e-7, 0.85 - 1e-7, 0.85)]
    blocks = {"x": texts, "y": prose(rng, 9, 5)}
    got = {(r.a, r.b) for r in simjoin.similarity_links(frame(spark, blocks), ["day"], 0.85, WIDTH, **way).collect()}
    want = brute(blocks, 0.85)
    if not way:
        assert got == want
    if "forest" in way:
        assert got <= want
    assert joined(got) == joined(want)


def joined(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_vectors_of_a_block_are_sent_once_for_each_chunk(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "COPIES", 0)
    texts = prose(np.random.default_rng(4), 300, 12)
    nodes = frame(spark, {"x": texts})

    def sent(list_nodes):
        monkeypatch.setattr(simjoin, "LIST_NODES", list_nodes)
        monkeypatch.setattr(simjoin, "CHUNK", 10)
        _, flat = simjoin.candidate_lists(nodes, ["day"], 0.85)
        return simjoin.chunked(flat[0]).count()

    assert sent(30) == 300  # one chunk
    assert sent(10) == 900  # three chunks
