"""Toxicity: averaged embeddings of words and their character n-grams in a linear softmax, trained jointly."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import held_out, labelled_sample, scan, texts_of
from .compression import logistic

#: The most texts of each class that are learned from, and the longest of them in characters.
ROWS_PER_CLASS, MAX_CHARS = 3000, 60_000
BUCKETS, WIDTH, SHORTEST, LONGEST = 1 << 17, 8, 3, 5
#: Words averaged together. A text scores as its most toxic passage, so a few words count in a long text as well.
PASSAGE, STEP = 4, 1
#: Passes over the sample: the first ones take longer passages, of which a toxic text's random few are taken as toxic.
EPOCHS, LONG_PASSES, LONG_PASSAGE, BATCH_WORDS, RATE, SEED = 12, 4, 48, 16_384, 0.5, 7
THRESHOLD = 0.3
CACHE_WORDS = 400_000

WORD = re.compile(r"[^\W_]+")
SCHEMA = "doc_id: bigint, score: double, predicted: int"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def subwords(word: str) -> list[int]:
    """Buckets of the word and of its character n-grams with marked ends."""
    w = f"<{word}>".encode("utf-16-le", "surrogatepass")  # two bytes a character, so n-grams are slices
    n = len(w)
    grams = [zlib.crc32(w[i : i + k]) for k in range(2 * SHORTEST, 2 * LONGEST + 1, 2) for i in range(0, n - k + 1, 2)]
    return [g % BUCKETS for g in (zlib.crc32(w), *grams)]


class Bags:
    """Words as numbers, with the flat list of each word's subwords."""

    def __init__(self, texts: list[str]):
        ids: dict[str, int] = {}
        self.texts = [np.array([ids.setdefault(w, len(ids)) for w in words_of(t)], np.int64) for t in texts]
        lists = [subwords(w) for w in ids]
        self.count = np.fromiter(map(len, lists), np.int64, len(lists))
        self.start = np.concatenate(([0], np.cumsum(self.count)))[:-1]
        self.flat = np.array([b for x in lists for b in x], np.int64)

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words one after another, and the position in ``words`` that each belongs to."""
        n = self.count[words]
        owner = np.repeat(np.arange(len(words)), n)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        return self.flat[self.start[words][owner] + within], owner


def starts_of(n: int, size: int, step: int) -> np.ndarray:
    """Starts of runs of ``size`` words, ``step`` apart, that cover all ``n`` words."""
    return np.array([0]) if n <= size else np.append(np.arange(0, n - size, step), n - size)


def fit(sample: list[tuple[str, int]], epochs: int = EPOCHS) -> dict | None:
    """Bucket scores and the calibration of a text's highest passage; None without both classes.

    Every passage of a clean text is clean. Of a toxic text only some are toxic: the first passes take long passages at random,
    later ones its two highest passages under the model so far. Embeddings and softmax move together (Adagrad).
    """
    labels = np.array([y for _, y in sample])
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(SEED)
    bags = Bags([t for t, _ in sample])
    train = np.arange(len(sample)) % 4 != 0
    emb = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    head = rng.normal(0, 0.1, (WIDTH, 2))
    bias = np.zeros(2)
    seen_e, seen_h = np.full(BUCKETS, 1e-6), np.full(WIDTH, 1e-6)
    toxic = [i for i in np.flatnonzero(train & (labels == 1)) if len(bags.texts[i])]
    clean = [i for i in np.flatnonzero(train & (labels == 0)) if len(bags.texts[i])]

    def drawn(i: int, size: int, k: int) -> list[np.ndarray]:
        w = bags.texts[i]
        return [w[a : a + size] for a in rng.integers(0, max(1, len(w) - size + 1), min(k, 1 + len(w) // size))]

    def highest(i: int, scores: np.ndarray, k: int) -> list[np.ndarray]:
        w = bags.texts[i]
        at = starts_of(len(w), PASSAGE, STEP)
        sums = np.concatenate(([0], np.cumsum(scores[w])))
        mean = (sums[np.minimum(at + PASSAGE, len(w))] - sums[at]) / min(PASSAGE, len(w))
        return [w[at[j] : at[j] + PASSAGE] for j in np.argsort(-mean, kind="stable")[:k]]

    for epoch in range(epochs):
        if epoch < LONG_PASSES:
            items = [(p, y) for y, part in ((1, toxic), (0, clean)) for i in part for p in drawn(i, LONG_PASSAGE, 4)]
        else:
            scores = np.add.reduceat((emb @ (head[:, 1] - head[:, 0]))[bags.flat], bags.start) / bags.count
            items = [(p, y) for y, part in ((1, toxic), (0, clean)) for i in part for p in highest(i, scores, 2)]
            items += [(p, 0) for i in clean for p in drawn(i, PASSAGE, 4)]
        order, at = rng.permutation(len(items)), 0
        while at < len(order):
            part, held = [], 0
            while at < len(order) and held < BATCH_WORDS:
                part.append(items[order[at]])
                held += len(part[-1][0])
                at += 1
            y = np.array([v for _, v in part])
            words = np.concatenate([p for p, _ in part])
            owner = np.repeat(np.arange(len(part)), [len(p) for p, _ in part])
            unique, inverse = np.unique(words, return_inverse=True)
            buckets, of_word = bags.of(unique)
            vectors = np.add.reduceat(emb[buckets], np.concatenate(([0], np.cumsum(bags.count[unique])))[:-1], axis=0)
            vectors /= bags.count[unique][:, None]
            total = np.bincount(owner, minlength=len(part))
            firsts = np.concatenate(([0], np.cumsum([len(p) for p, _ in part])))[:-1]
            mean = np.add.reduceat(vectors[inverse], firsts, axis=0) / total[:, None]
            z = mean @ head + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
            g = p * weight[:, None]
            g_head, g_mean = mean.T @ g, (g @ head.T) / total[:, None]
            used, back = np.unique(buckets, return_inverse=True)
            g_words = np.stack([np.bincount(inverse, g_mean[owner, k], len(unique)) for k in range(WIDTH)], 1) / bags.count[unique][:, None]
            g_emb = np.stack([np.bincount(back, g_words[of_word, k], len(used)) for k in range(WIDTH)], 1)
            seen_e[used] += (g_emb**2).mean(1)
            emb[used] -= RATE * g_emb / np.sqrt(seen_e[used])[:, None]
            seen_h += (g_head**2).sum(1)
            head -= RATE * 0.2 * g_head / np.sqrt(seen_h)[:, None]
            bias -= 0.05 * g.sum(0)
    per_bucket = (emb @ (head[:, 1] - head[:, 0])).astype(np.float32)
    model = {"buckets": per_bucket, "weights": None}
    rest = np.flatnonzero(~train)
    tops = highest_passages(per_bucket)([sample[i][0] for i in rest])
    if len(set(labels[rest].tolist())) < 2:
        rest, tops = np.arange(len(sample)), highest_passages(per_bucket)([t for t, _ in sample])
    model["scale"] = float(np.std(tops) or 1.0)
    model["weights"] = logistic(inputs(tops, model["scale"]), labels[rest].astype(float))
    return model


def inputs(tops: np.ndarray, scale: float) -> np.ndarray:
    return np.stack([np.ones_like(tops), tops / scale], 1)


def highest_passages(per_bucket: np.ndarray):
    """A function from texts to the highest passage average of each; 0 without words."""

    class Known(dict):
        def __missing__(self, word):
            if len(self) >= CACHE_WORDS:
                self.clear()
            at = subwords(word)
            self[word] = out = sum(map(of_bucket, at)) / len(at)
            return out

    known, of_bucket = Known(), per_bucket.tolist().__getitem__

    def score(texts) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            if words := words_of(t):
                n = len(words)
                sums = np.concatenate(([0.0], np.cumsum(np.fromiter(map(known.__getitem__, words), float, n))))
                at = starts_of(n, PASSAGE, STEP)
                out[i] = (sums[np.minimum(at + PASSAGE, n)] - sums[at]).max() / min(PASSAGE, n)
        return out

    return score


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, max_chars: int = MAX_CHARS) -> dict | None:
    """The model from a bounded sample of labelled texts that are not held out."""
    return fit(labelled_sample(docs, labels, "toxic", rows_per_class, max_chars))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: dict | None = None, **bounds: int) -> DataFrame:
    """Probability that a text is toxic, for every whole text.

    Reads ``doc_id`` and ``text``, and ``doc_id`` and ``toxic`` of the labels; other columns are ignored. A passage of a few words
    is the average of the vectors of its words and their character n-grams, so a misspelling never seen shares most of its
    vectors with the word it stands for; a linear softmax turns it into a log-odds, and the highest passage of the whole text is
    calibrated on labelled texts outside the training part. The fit reads a bounded sample (``rows_per_class``, ``max_chars``).

    Null and empty texts, and texts without words, get the score of a passage of log-odds 0; without labels of both classes every
    score is 0. Null labels are left out, of repeated labels the larger holds. Repeated rows give repeated results; an empty table
    gives none.
    """
    model = model or train(docs, labels, **bounds)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = sent.value
        highest = highest_passages(m["buckets"]) if m else None

        def work(batch):
            texts = texts_of(batch)
            p = np.zeros(len(texts))
            if m:
                p = 1 / (1 + np.exp(-np.clip(inputs(highest(texts), m["scale"]) @ m["weights"], -30, 30)))
            yield {"doc_id": batch.column(0), "score": p, "predicted": (p >= threshold).astype(np.int32)}

        return work

    out = scan(docs, ["doc_id", "text"], SCHEMA, start)
    return out.withColumn("held_out", held_out(out["doc_id"]))
