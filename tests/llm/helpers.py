"""Small documents with every odd case: nulls in each column, empty and long texts, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

LETTERS = "etaoinshrdlu"
#: Names that the operators use inside or return; as extra input columns they must not matter.
EXTRA = "n_words int, score double, key string, shard int, size int, bucket int, label string, words int, bv int, kept boolean, a int, lo int"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"
FILL = (1, 0.5, "k", 3, 4, 5, "l", 6, 7, True, 8, 9)


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(LETTERS, k=rng.randint(2, 9))) for _ in range(n))


def frame(spark, rows):
    """Documents from (doc_id, text[, lang[, source]])."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, "en", "src0")[:4] if len(r) < 4 else r
        full.append((doc_id, text, lang, source, len(text or ""), *FILL))
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def odd_rows(rng: random.Random):
    long = "\n".join(prose(rng, 40) for _ in range(600))
    plain = prose(rng, 120)
    return [
        (None, prose(rng, 30)), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, plain), (5, plain), (6, plain), (7, long), (8, long + " " + plain),
        (9, plain + "\n" + plain), (10, prose(rng, 60), None, None), (11, "É ß 漢字 x y 😀 " * 30), (12, "la " * 500), (None, None, None, None),
    ]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
