"""Ranked search against the formula, document by document."""

import math
import random
import re
from collections import Counter

import numpy as np

from patchpulse.llm import ranking

from .helpers import empty, frame, odd_rows, prose

WORD = re.compile(ranking.TERM)
FOLD = {c: c + 32 for c in range(65, 91)}


def brute(rows, items, top):
    bags = [Counter(WORD.findall((t or "").translate(FOLD))) for _, t, *_ in rows]
    docs, total = sum(bool(b) for b in bags), sum(sum(b.values()) for b in bags)
    df = Counter(w for b in bags for w in b)
    out = []
    for item_id, text in items:
        asked = Counter(WORD.findall((text or "").translate(FOLD)))
        scores = []
        for (doc, *_), bag in zip(rows, bags):
            m = 75 + (25 * sum(bag.values()) * docs) // total
            score = sum(c * math.floor(1000 * math.log((2 * docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * bag[w]) // (1000 * bag[w] + 12 * m)) for w, c in asked.items() if bag[w])
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item_id, i + 1, None if null else doc, -s) for i, (s, null, doc) in enumerate(sorted(scores)[:top])]
    return Counter(out)


def asked(spark, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id bigint, text string, rank string, score int")


def rows_and_items(rng):
    words = [prose(rng, 1) for _ in range(60)]
    rows = odd_rows(rng) + [(100 + i, " ".join(rng.choices(words, [1 / (1 + k) for k in range(60)], k=rng.randint(1, 60)))) for i in range(400)]
    rows += [(100 + i, rows[40 + i][1]) for i in range(0, 90, 3)] + [(5, "Zig-ZAG zag"), (4, "zig_zag ZIG"), (3000, "zig zag zag")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(30)]
    return rows, items + [(90, None), (91, ""), (92, "?!"), (93, "zig zag zag"), (94, "É 漢字"), (95, "unseen words only"), (96, rows[8][1]), (7, items[7][1]), (None, "la")]


def test_ranks_equal_the_formula(spark):
    rows, items = rows_and_items(random.Random(1))
    for options in ({}, {"top": 3}, {"block_bytes": 60_000}):
        got = ranking.search(frame(spark, rows), asked(spark, items), **options)
        assert Counter(map(tuple, got.collect())) == brute(rows, items, options.get("top", ranking.TOP)), options
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


def test_shards_and_depths_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SHARD_DOCS", 17)
    monkeypatch.setattr(ranking, "FIRST_DEPTH", 1)
    rows, items = rows_and_items(random.Random(2))
    assert Counter(map(tuple, ranking.search(frame(spark, rows), asked(spark, items)).collect())) == brute(rows, items, ranking.TOP)


def test_reading_stops_when_bounds_are_settled():
    # one rare term with a high weight decides; the long list of the common one is not read to its end
    n = 4000
    terms = [np.array([0, 1] if d == 9 else [0], np.uint32).tobytes() for d in range(n)]
    counts = [np.array([50, 9] if d == 9 else [1 + d % 5], np.uint32).tobytes() for d in range(n)]
    lists = ranking.Lists(np.full(n, 100), terms, counts, 2)
    read = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                read.append(key.stop - key.start)
            return super().__getitem__(key)

    lists.doc = lists.doc.view(Watched)
    live, scores = lists.best([0, 1], [1, 5000], 1, 0)
    assert live.tolist() == [9] and scores[0] == 50_000_000_000 // (50_000 + 1200) + 5000 * (9_000_000_000 // (9000 + 1200))
    assert sum(read) < n / 2


def test_terms_of_a_text_in_pieces(monkeypatch):
    rng = random.Random(3)
    raw = (prose(rng, 300) + " " + "q" * 90 + "--" + prose(rng, 50)).replace(" a", "\n, A").encode()
    whole = [w for part in ranking.terms_of(raw) for w in part]
    assert whole == [w.encode() for w in WORD.findall(raw.decode().translate(FOLD))]
    for size in (1, 7, 40):
        monkeypatch.setattr(ranking, "PIECE_BYTES", size)
        assert [w for part in ranking.terms_of(raw) for w in part] == whole


def test_empty_tables(spark):
    items = asked(spark, [(1, "a b")])
    assert ranking.search(empty(spark), items).count() == 0
    assert ranking.search(frame(spark, [(1, "a")]), items.limit(0)).count() == 0
    assert ranking.search(frame(spark, [(1, None)]), items).count() == 0
