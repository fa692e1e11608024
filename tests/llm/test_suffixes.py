"""Repeated byte strings against brute force: suffix arrays, common prefixes, merging, removal."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from patchpulse.llm import suffixes

from .helpers import empty, frame, odd_rows, prose


def laid_out(parts):
    """Codes of parts with gaps, and where the parts lie."""
    lengths = np.array([len(p) for p in parts])
    starts = np.concatenate(([0], np.cumsum(lengths + suffixes.GAP)[:-1]))
    codes = np.zeros(int((lengths + suffixes.GAP).sum()), np.uint8)
    for p, s in zip(parts, starts):
        codes[s : s + len(p)] = np.frombuffer(p, np.uint8) - 96
    return codes, starts, starts + lengths


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefghijklmnop"])
def test_suffix_order_and_common_prefixes(letters):
    rng = random.Random(len(letters))
    for _ in range(30):
        parts = ["".join(rng.choices(letters, k=rng.randint(1, 40))).encode() for _ in range(rng.randint(1, 6))]
        parts += [parts[0]] * rng.randint(0, 2)
        codes, starts, ends = laid_out(parts)
        suffix = {s + i: (p[i:], k) for k, (p, s) in enumerate(zip(parts, starts.tolist())) for i in range(len(p))}
        order = suffixes.suffix_array(codes, starts, ends)
        assert order.tolist() == sorted(suffix, key=suffix.get)
        prefix = suffixes.common_prefixes(codes, starts, ends, order).tolist()
        assert prefix[0] == 0
        for x, y, n in zip(order.tolist(), order.tolist()[1:], prefix[1:]):
            x, y = suffix[x][0], suffix[y][0]
            assert n == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_runs_are_merged_by_search():
    rng = np.random.default_rng(1)
    runs = [np.sort(rng.integers(0, 50, rng.integers(0, 30)).astype(np.uint64)) for _ in range(7)]
    keys, at = suffixes.merged(runs)
    flat = np.concatenate(runs)
    assert (keys == np.sort(flat)).all() and (flat[at] == keys).all() and sorted(at.tolist()) == list(range(len(flat)))


def test_anchor_of_a_string_depends_on_it_alone():
    rng = random.Random(2)
    raw = np.frombuffer(prose(rng, 900).encode(), np.uint8)
    held = set(suffixes.anchors(raw).tolist())
    for i in range(0, len(raw) - suffixes.LENGTH, 97):
        own = suffixes.grams(raw[i : i + suffixes.LENGTH])[1]
        assert len(own) == 1 and own[0] == suffixes.grams(raw)[1][i] and int(own[0]) in held


def brute(texts):
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        left = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(g and not p for g, p in zip(gone, b"\0" + gone)), hashlib.sha256(left).hexdigest()))
    return out


def checked(spark, rows, **options):
    got = suffixes.remove_repeated_bytes(frame(spark, rows), **options)
    expected = Counter((d, *x) for (d, *_), x in zip(rows, brute([(t or "").encode() for _, t, *_ in rows])))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == expected
    return got, expected


def shared_rows(rng):
    passages = [prose(rng, 150)[:n] for n in (398, 399, 400, 401, 450, 700)]
    rows = odd_rows(rng)
    for i in range(50):
        parts = [prose(rng, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), prose(rng, rng.randint(0, 20))]
        rows.append((1000 - 3 * i, "ß".join(parts)))
    rows += [(2000, passages[5] + "x" + passages[5]), (2001, "y" * 1500), (2002, "é" * 600), (2003, prose(rng, 300)[:400])]
    return rows


def test_repeated_bytes_are_removed(spark):
    rows = shared_rows(random.Random(3))
    got, expected = checked(spark, rows, with_text=True)
    assert sum(x[2] for x in expected) > 20_000
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())


def test_blocks_and_buckets_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_KEYS", 50)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 20_000)
    checked(spark, shared_rows(random.Random(4)), bucket_bytes=500)


def test_long_text_over_pieces(spark):
    rng = random.Random(5)
    long = prose(rng, 420_000)
    assert len(long) > 2 * suffixes.PIECE_BYTES
    part = long[suffixes.PIECE_BYTES - 300 : suffixes.PIECE_BYTES + 350]
    got = {r.doc_id: r for r in suffixes.remove_repeated_bytes(frame(spark, [(1, long), (2, "head|" + part + "|tail")])).collect()}
    assert got[1].n_removed == got[2].n_removed == len(part) and got[1].n_spans == got[2].n_spans == 1
    assert got[1].kept_sha256 == hashlib.sha256(long.replace(part, "").encode()).hexdigest()


def test_empty_table(spark):
    assert suffixes.remove_repeated_bytes(empty(spark)).count() == 0
