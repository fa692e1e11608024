"""Phrases against a plain count."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from patchpulse.llm import collocations

from .helpers import empty, frame, odd_rows, prose

FOLD = {c: c + 32 for c in range(65, 91)}


def brute(rows, words=3, least=10, top=2000, share=50):
    f, n = defaultdict(Counter), Counter()
    for _, text, *more in rows:
        lang = (more[0] if more else "en") or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, words + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        many = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        dropped = {p[i : i + m] for p, a in many.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= share * many[p[i : i + m]]}
        found = []
        for p, a in many.items():
            if p not in dropped:
                score, _, l, r = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return Counter(out)


def some_rows(rng):
    words = [prose(rng, 1) for _ in range(25)] + ["É", "ß", "A\x00b", "\x00", "\x1c", " x"]
    rows = odd_rows(rng)
    for i in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\x0b", "; "]) for _ in range(rng.randint(0, 80)))
        rows.append((i, text.upper() if i % 7 == 0 else text, rng.choice(["en", "de", None, "und"]), "s"))
    return rows + [(900, "to be or " * 200, "fr", "s"), (901, "x y", "aa", "s")]


@pytest.mark.parametrize("options", [{}, {"top": 7}, {"words": 2, "least": 3}, {"share": 90, "partition_bytes": 300}])
def test_phrases_equal_a_plain_count(spark, options):
    rows = some_rows(random.Random(1))
    got = collocations.collocations(frame(spark, rows), **options)
    assert Counter(map(tuple, got.collect())) == brute(rows, **{k: v for k, v in options.items() if k != "partition_bytes"})
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def unpacked(rows):
    packer, out, pieces = collocations.Packer(), Counter(), 0
    for part in rows:
        for lang, raw in zip(part["lang"], part["run"]):
            words, cells, counts = packer.unpack(raw)
            keys = list(zip(*(c.tolist() for c in cells)))
            assert keys == sorted(keys) and words == sorted(words)
            pieces += 1
            for key, c in zip(keys, counts.tolist()):
                out[(lang, *(words[i - 1] for i in key if i))] += c
    return out, pieces


def test_bursts_spills_and_new_numbers_keep_all_counts(monkeypatch):
    rng = random.Random(2)
    texts = [("en" if i % 3 else "de", prose(rng, rng.randint(0, 60)).encode()) for i in range(60)] + [("en", ("hot " + prose(rng, 1) + " ").encode() * 400), ("en", b"hot " * 900)]

    def run():
        work = collocations.Counting(3, 3)
        return unpacked([*(r for lang, raw in texts for r in work.text(lang, raw)), *work.count(), *work.spill(0)])

    whole, few = run()
    for name, value in (("BURST", 20), ("HELD", 300), ("VOCABULARY", 90), ("BATCH_WORDS", 100), ("PIECE_BYTES", 50)):
        monkeypatch.setattr(collocations, name, value)
    parts, many = run()
    assert parts == whole and many > few


def test_containers_burst_between_words(monkeypatch):
    monkeypatch.setattr(collocations, "BURST", 4)
    trie, bits = collocations.Trie(), collocations.ID_BITS
    keys = np.array(sorted((w << 2 * bits) | (x << bits) | y for w in (2, 3) for x in range(6) for y in range(3)), np.uint64)
    assert trie.add(keys, np.ones(len(keys), np.int64)) == 36
    assert len(trie.leaves) > 6 and trie.bounds == sorted(trie.bounds) and all(b % (1 << bits) == 0 for b in trie.bounds)
    assert trie.add(keys, np.ones(len(keys), np.int64)) == 0
    for i, leaf in enumerate(trie.leaves):
        assert all(trie.bounds[i] <= k and (i + 1 == len(trie.bounds) or k < trie.bounds[i + 1]) and c == 2 for k, c in leaf.items())


def test_empty_table(spark):
    assert collocations.collocations(empty(spark)).count() == 0


def test_sorting_new_words_looks_no_old_word_up():
    work = collocations.Counting(4, 3)
    rng = np.random.default_rng(2)
    looked_up = []

    class Watched(collocations.Numbers):
        def __getitem__(self, word):
            looked_up.append(word)
            return super().__getitem__(word)

    work.ids = Watched()
    for size in (500, 3, 0, 200):
        for w in {b"w%d" % x for x in rng.integers(0, 5000, size)}:
            work.ids[w]
        looked_up.clear()
        words, rank, hashed = work.ordered()
        assert not looked_up
        names = list(work.ids)
        assert words.tolist() == sorted(names)
        assert [int(rank[i + 1]) for i in range(len(names))] == [words.tolist().index(w) + 1 for w in names]
        assert len(hashed) == len(names) + 1 and len(set(hashed.tolist())) == len(names) + 1
