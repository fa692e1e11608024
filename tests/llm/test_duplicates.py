"""Near-duplicates and repeated passages against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from patchpulse.llm import neardup, substrings

from .helpers import empty, frame, odd_rows, prose


def sets_of(text):
    w = (text or "").encode().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_classes(rows):
    texts = sorted({t or "" for _, t, *_ in rows})
    sets = [sets_of(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return {t: label[i] for i, t in enumerate(texts)}


def variants(rng, n, words=150, edits=8):
    """A base text and copies with a few words changed."""
    base = prose(rng, words).split()
    out = [" ".join(base)]
    for _ in range(n - 1):
        w = base[:]
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("chunk", [neardup.CHUNK, 8])
def test_near_duplicate_classes(spark, monkeypatch, chunk):
    monkeypatch.setattr(neardup, "CHUNK", chunk)  # small chunks send the large groups through blocks
    rng = random.Random(1)
    rows = odd_rows(rng)
    texts = variants(rng, 60) + variants(rng, 70, words=90, edits=11) + variants(rng, 5, edits=2) + variants(rng, 3, words=7, edits=1) + [prose(rng, 80) for _ in range(40)]
    rows += [(100 + i, t) for i, t in enumerate(texts)] + [(90, texts[3]), (91, texts[3] + "  "), (300, "one two"), (301, "one  two")]
    expected = brute_classes(rows)
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    members = {}
    for r, text in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id, r.key)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))):
        members.setdefault(expected[text[1] or ""], set()).add((r.class_id, r.class_size))
    assert all(len(v) == 1 for v in members.values())
    assert len({x for v in members.values() for x in v}) == len(members)
    kept = neardup.one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert kept.count() == len(set(expected.values()))


def test_blocks_find_links_that_leaders_miss(spark):
    # one bucket: its leader is like none of the others, two of which are alike
    table = [("p", str(k), str(k), substrings.pack(np.array(s, np.uint64), neardup.KEY_BYTES), left) for k, s in enumerate(([1, 2, 3, 4, 5, 6], [7, 8, 9, 10, 11], [7, 8, 9, 10, 11, 12], [20])) for left in (True, False)]
    rows = spark.createDataFrame(table, "pair string, key string, label string, shingles binary, is_left boolean")
    assert {frozenset((r.a, r.b)) for r in neardup.block_links(rows, 0.8).collect()} == {frozenset("12")}


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(3)
    keys = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    wx, wy = rng.uniform(0.2, 3, 300), rng.uniform(0.2, 3, 300)
    wx[:40], wy[-40:] = 0, 0
    ax, ay = wx > 0, wy > 0
    same = []
    for salt in range(40):  # many salted repeats make the registers' mean sharp
        k = keys + np.uint64(salt * 7919)
        s = neardup.signatures(np.repeat([0, 1], [ax.sum(), ay.sum()]), np.concatenate([k[ax], k[ay]]), np.concatenate([wx[ax], wy[ay]]), 2)
        same.append((s[0] == s[1]).mean())
    both = np.flatnonzero(ax & ay)
    exact = sum(1 / np.maximum(wx / wx[d], wy / wy[d]).sum() for d in both)
    assert abs(np.mean(same) - exact) < 0.02


def test_classes_of_links(spark):
    from patchpulse.llm.common import classes

    links = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (100, 101), (7, 7)] + [(200, 200 + i) for i in range(1, 50)]
    got = {r.node: r.label for r in classes(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 50 for i in (50, 100, 101)} | {i: 200 for i in range(200, 250)}


def brute_removal(rows, size=13):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    for d, w in split:
        for i in range(len(w) - size + 1) if d is not None else ():
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, d), d)
    out = Counter()
    for d, w in split:
        gone = set()
        for i in range(len(w) - size + 1) if d is not None else ():
            if first[tuple(w[i : i + size])] < d:
                gone |= set(range(i, i + size))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[(d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())] += 1
    return out


def test_repeated_passages(spark):
    rng = random.Random(7)
    shared = [prose(rng, n) for n in (12, 13, 14, 19, 20, 60)]
    rows = odd_rows(rng)
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), prose(rng, rng.randint(0, 8))]
        rows.append((1000 - 3 * i, "\n".join(parts)))
    got = substrings.remove_repeats(frame(spark, rows), with_text=True).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_removal(rows)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    small = substrings.remove_repeats(frame(spark, rows), bucket_bytes=500)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in small.collect()) == brute_removal(rows)


def test_every_alignment_of_a_window_is_found(spark):
    rng = random.Random(8)
    passage = prose(rng, 13)
    rows = [(i, prose(rng, i) + " " + passage + " " + prose(rng, 9)) for i in range(1, 30)]
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(frame(spark, rows)).collect()}
    assert got == {1: 0} | {i: 13 for i in range(2, 30)}


def test_word_hashes_in_pieces(monkeypatch):
    rng = random.Random(9)
    raw = prose(rng, 3000).replace(" a", "\n\t").encode()
    whole = substrings.word_hashes(raw)
    monkeypatch.setattr(substrings, "PIECE_BYTES", 100)
    assert (substrings.word_hashes(raw) == whole).all() and len(whole) == len(raw.split())
    assert len(set(whole.tolist())) == len(set(raw.split()))


def test_empty_tables(spark):
    assert neardup.near_duplicates(empty(spark)).count() == 0
    assert neardup.one_of_each(empty(spark)).count() == 0
    assert substrings.remove_repeats(empty(spark)).count() == 0
