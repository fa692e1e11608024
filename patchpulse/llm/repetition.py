"""Quality rules on repetition: characters inside repeated n-grams and lines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import mix64, scan, texts_of

#: Largest share of a text's word characters in n-grams seen earlier in it, by n-gram length, and of characters in lines seen
#: earlier. A short text that closes with its own heading stays well below.
NGRAM_LIMITS = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
LINE_LIMIT = 0.30
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 50, 50, 3
SYMBOLS = b"#*$%&|<>"
SPACES = b"\t\n\x0b\x0c\r "
BASE = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = (
    "doc_id: bigint, n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint, "
    "base_failed: boolean, kept: boolean, ngram_shares: array<double>, line_share: double"
)


def repeated(keys: np.ndarray, first: bool) -> np.ndarray:
    """Marks the keys that occur twice or more, with or without their first occurrence."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    if first:
        out[order[:-1][same]] = True
    return out


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Marks the words inside windows of ``length`` words at the marked starts."""
    change = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(change, at, 1)
    np.add.at(change, at + length, -1)
    return np.cumsum(change[:n]) > 0


def measure(text: str | None, ngrams: tuple[int, ...]) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, shares of characters by n-gram length, and in lines."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    dup_lines = len(lines) - len(set(lines))
    if not n:
        return 0, 0, symbols, dup_lines, 0, [0.0] * len(ngrams), 0.0
    points = np.frombuffer(b"".join(words), np.uint8)
    byte_ends = np.cumsum(np.fromiter(map(len, words), np.int64, n))
    before = np.concatenate(([0], np.cumsum((points & 0xC0) != 0x80)))
    chars = np.diff(before[np.concatenate(([0], byte_ends))])
    word_chars = int(chars.sum())
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    repeat_words = 0
    if n >= REPEAT_WINDOW:
        _, pairs = np.unique(at[:-1] * len(ids) + at[1:], return_inverse=True)  # exact: pairs are numbered anew
        marked = repeated(pairs[:-1] * len(ids) + at[2:], first=True)
        repeat_words = int(covered(marked, REPEAT_WINDOW, n).sum())
    shares = []
    mixed, rolled, length = mix64((at + 1).astype(np.uint64)), None, 0
    again = bool(repeat_words)
    for size in ngrams:
        share = 0.0
        if again and n >= size:
            while length < size:  # the hash of one more word
                length += 1
                rolled = mixed.copy() if rolled is None else rolled[:-1] * BASE + mixed[length - 1 :]
            hits = repeated(rolled, first=False)
            again = bool(hits.any())  # without a repeated n-gram no longer one repeats
            share = float(chars[covered(hits, size, n)].sum()) / word_chars if again else 0.0
        shares.append(share)
    line_share = 0.0
    if dup_lines:
        seen, twice, total = set(), 0, 0
        for x in lines:
            k = len(x.decode("utf-8", "surrogatepass"))
            total += k
            twice += k if x in seen else 0
            seen.add(x)
        line_share = twice / total
    return n, word_chars, symbols, dup_lines, repeat_words, shares, line_share


def repetition_quality(docs: DataFrame, ngram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """Repetition of every whole text, and whether it is kept.

    Reads ``doc_id`` and ``text``; other columns are ignored, whatever their names. Words are runs without ASCII white
    space. For each n-gram length a rolling hash over the word numbers finds n-grams seen earlier in the text; the characters
    inside them, each counted once, are given as a share of all word characters (``ngram_shares``, by rising length). ``line_share`` is
    the share of characters in lines equal to an earlier one. A text fails the base rule with fewer than 50 words or with
    more than half of its words in repeated 3-word windows; it is kept if it passes that rule and no share exceeds its limit.

    Null and empty texts have no words, fail the base rule and are not kept. Repeated rows give repeated results; an
    empty table gives none. Long texts take memory in proportion to one text.
    """
    limits = ngram_limits or NGRAM_LIMITS
    sizes = tuple(sorted(limits))

    def start():
        def work(batch):
            rows = [measure(t, sizes) for t in texts_of(batch)]
            failed = [r[0] < MIN_WORDS or 100 * r[4] > MAX_REPEAT_PERCENT * r[0] for r in rows]
            kept = [not f and r[6] <= line_limit and all(s <= limits[k] for s, k in zip(r[5], sizes)) for r, f in zip(rows, failed)]
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ngram_shares", "line_share")
            yield {"doc_id": batch.column(0), "base_failed": failed, "kept": kept} | {k: [r[i] for r in rows] for i, k in enumerate(names)}

        return work

    return scan(docs, ["doc_id", "text"], SCHEMA, start)
