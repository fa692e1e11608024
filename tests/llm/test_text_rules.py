"""Repetition, benchmark windows and secrets against plain re-computations."""

import hashlib
import random
import re
from collections import Counter

import pytest

from patchpulse.llm import decontaminate, repetition, secrets

from .helpers import empty, frame, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: repr(sorted(r.items(), key=lambda x: x[0])))


def test_repetition_base_columns(spark):
    rng = random.Random(1)
    rows = odd_rows(rng) + [(20, "a b c\na b c\n\n \nx #$ a b c d e"), (21, "q\n" * 30), (22, "w1 w2 w3 " * 40 + "#*$%&|<>")]
    got = rows_of(repetition.repetition_quality(frame(spark, rows)))
    assert len(got) == len(rows)
    expected = Counter()
    for doc_id, text, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        again = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        expected[(doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == expected
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_repetition_verdict(spark):
    rng = random.Random(2)
    clean = prose(rng, 200)
    phrase = prose(rng, 12)
    rows = [(1, clean), (2, clean + "\n" + phrase + "\n" + prose(rng, 80) + "\n" + phrase), (3, "\n".join([prose(rng, 40)] * 2 + [prose(rng, 20)] + [prose(rng, 40)] * 2))]
    got = {r["doc_id"]: r for r in rows_of(repetition.repetition_quality(frame(spark, rows)))}
    assert got[1]["kept"] and got[2]["kept"] and not got[3]["kept"]
    assert got[1]["ngram_shares"] == [0.0] * 6 and 0 < got[2]["ngram_shares"][0] < 0.1


def test_repetition_shares_by_brute_force():
    rng = random.Random(3)
    for _ in range(30):
        words = [rng.choice("abc") * rng.randint(1, 3) for _ in range(rng.randint(1, 60))]
        shares = repetition.measure(" ".join(words), (5, 6))[5]
        for n, share in zip((5, 6), shares):
            seen, inside = set(), set()
            for i in range(len(words) - n + 1):
                w = tuple(words[i : i + n])
                inside |= set(range(i, i + n)) if w in seen else set()
                seen.add(w)
            assert share == pytest.approx(sum(len(words[i]) for i in inside) / sum(map(len, words)))


def brute_windows(rows, items, size=10):
    held = {}
    for item, text in items:
        words = PLAIN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        for i in range(max(1, len(words) - size + 1)) if words and item is not None else ():
            held.setdefault(tuple(words[i : i + size]), set()).add(str(item))
    out = Counter()
    for doc_id, text, *_ in rows:
        words = PLAIN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        hit, found = set(), set()
        for w, owners in held.items():
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found |= owners
        out[(doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    return out


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 300])
def test_benchmark_windows(spark, block):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.choice((1, 3, 9, 10, 11, 25)))) for i in range(12)] + [(50, None), (51, ""), (52, "?!"), (None, prose(rng, 15)), (3, prose(rng, 12))]
    items += [(60, items[5][1]), (61, "Ünïcode  WORDS, stay: as they are; in 2 parts or 3 of them")]
    rows = odd_rows(rng)
    for i, (_, text) in enumerate(items):
        if text:
            words = text.split()
            rows += [(100 + i, prose(rng, 5) + ".\n" + " -- ".join(words).upper() + "! " + prose(rng, 5)), (200 + i, prose(rng, 4) + " " + " ".join(words[1:]) + " " + prose(rng, 3))]
    bench = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id bigint, text string, doc_id int")
    got = decontaminate.decontaminate(frame(spark, rows), bench, block_bytes=block).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute_windows(rows, items)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        for s in r.spans:
            piece = texts[r.doc_id][s.start : s.end]
            assert PLAIN.fullmatch(piece[0].lower()) and PLAIN.fullmatch(piece[-1].lower())
    kept = decontaminate.clean_only(frame(spark, rows), bench)
    assert kept.columns == frame(spark, rows).columns
    assert kept.count() == sum(not r.contaminated for r in got)


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0
    assert decontaminate.decontaminate(frame(spark, [(1, "a b")]), bench).first().n_items == 0
    assert repetition.repetition_quality(empty(spark)).count() == 0
    assert secrets.secret_spans(empty(spark)).count() == 0


def test_secret_base_spans(spark):
    rng = random.Random(5)
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    hexes = "".join(rng.choices("0123456789abcdef", k=40))
    rows = odd_rows(rng) + [
        (30, f'é token = "{hexes}" and PassWord:abc secret: token: abcdefgh'), (31, "AKIA" + "A1" * 8 + " AKIAAKIA" + "B2" * 7 + " xAKIA123"), (32, f"{hexes[:23]} {hexes[:24]} {hexes.upper()}"),
        (33, "api_key='short' apikey=longenough7 toKen=abcdefgh ſecret=abcdefgh"), (34, f"token={hexes}" * 3),
    ]
    got = secrets.secret_spans(frame(spark, rows)).collect()
    expected = Counter()
    for doc_id, text, *_ in rows:
        text = text or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        line = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        expected[(doc_id, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(line.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == expected


def test_secret_density():
    count = secrets.token_counter(open(secrets.VOCABULARY, "rb").read())

    def dense(text):
        return [text[a:b] for a, _, b in secrets.dense_spans(text, secrets.base_spans(text), count, secrets.CHARS_PER_TOKEN)]

    key = "ghp_16C7e42F292c6912E7710c838347Ae178B4a"
    assert dense(f"see {key}.") == [key]
    assert dense("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY") == ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"]
    for plain in ("thisIsAnIdentifier_with_words_2023", "/usr/local/lib/python/site-packages", "123e4567-e89b-12d3-a456-426614174000", "D41D8CD98F00B204E9800998ECF8427E", "1234567890" * 3, "A-" * 5000):
        assert dense(plain) == []
    assert dense(f"token = {key}") == []  # a base span already


def test_secret_density_of_keys_made_of_letters():
    count = secrets.token_counter(open(secrets.VOCABULARY, "rb").read())
    rng = random.Random(7)

    def share(make):
        keys = [make() for _ in range(500)]
        return sum(secrets.dense_spans(f"see {k}.", [], count, secrets.CHARS_PER_TOKEN) == [(4, 3, 4 + len(k))] for k in keys) / len(keys)

    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    assert share(lambda: "".join(rng.choices(lower, k=20))) > 0.88
    assert share(lambda: "".join(rng.choices(upper, k=20))) > 0.97
    assert share(lambda: "".join(rng.choices(lower + upper, k=20))) > 0.98
    assert share(lambda: "".join(rng.choices(upper + "234567", k=20))) > 0.98
    assert share(lambda: "-".join("".join(rng.choices(upper, k=5)) for _ in range(5))) > 0.98
    names = ("get_value_by_name_and_id_of_it", "internationalization-of-documentation", "2023-01-15_12-30-45_0001", "electroencephalographically", "a_b_c_d_e_f_g_h_i_j_k_l")
    assert [n for n in names if secrets.dense_spans(n, [], count, secrets.CHARS_PER_TOKEN)] == []
