"""Quality classifier by compression: dictionaries of good and of bad text, and which of them shortens a text more."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import held_out, labelled_sample, scan, ship_package, texts_of

#: The most texts of each class that are learned from, and the longest of them in characters.
ROWS_PER_CLASS, MAX_CHARS = 3000, 100_000
DICTIONARY_BYTES, BLOCK_BYTES, LEVEL = 64_000, 4096, 3
THRESHOLD = 0.7

SCHEMA = "doc_id: bigint, score: double, predicted: int, good_bytes: bigint, bad_bytes: bigint"


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), compression_params=params)


def blocks(text: str | None) -> list[bytes]:
    """The whole text in blocks, so that the dictionary counts as much at the end of a long text as at its start."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]


def sizes(text: str | None, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> tuple[int, int, int]:
    """Bytes of the text, and of its blocks compressed with either dictionary."""
    parts = blocks(text)
    return sum(map(len, parts)), sum(len(good.compress(x)) for x in parts), sum(len(bad.compress(x)) for x in parts)


def inputs(measured: list[tuple[int, int, int]]) -> np.ndarray:
    """The normalised difference, and how far the text shrinks at all, linear and squared; zeros for an empty text."""
    n, g, b = np.array(measured, float).reshape(-1, 3).T
    some = n > 0
    difference = np.where(some, (b - g) / np.maximum(g + b, 1), 0)
    shrunk = np.where(some, np.log(np.maximum(np.minimum(g, b), 1) / np.maximum(n, 1)) + 1, 0)
    return np.stack([np.ones_like(n), 10 * difference, shrunk, shrunk**2, 10 * difference * shrunk], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; classes count by their numbers."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(sample: list[tuple[str, int]], dictionary_bytes: int = DICTIONARY_BYTES) -> dict | None:
    """Dictionaries from two thirds of the sample and the calibration from the rest; None without both classes."""
    train = [x for i, x in enumerate(sample) if i % 3]
    rest = [x for i, x in enumerate(sample) if i % 3 == 0]
    made = []
    for label in (1, 0):
        parts = [b for text, y in train if y == label for b in blocks(text)]
        if not parts:
            return None
        try:
            made.append(zstandard.train_dictionary(dictionary_bytes, parts).as_bytes())
        except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
            made.append(b"".join(parts)[-dictionary_bytes:])
    good, bad = map(compressor, made)
    y = np.array([label for _, label in rest], float)
    if len(set(y)) < 2:
        return None
    return {"good": made[0], "bad": made[1], "weights": logistic(inputs([sizes(t, good, bad) for t, _ in rest]), y)}


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, max_chars: int = MAX_CHARS) -> dict | None:
    """The model from a bounded sample of labelled texts that are not held out."""
    return fit(labelled_sample(docs, labels, "quality", rows_per_class, max_chars))


def scorer(model: dict | None):
    """A function from texts to (score, good bytes, bad bytes)."""
    if model is None:
        return lambda texts: [(0.5, 0, 0) for _ in texts]
    good, bad = compressor(model["good"]), compressor(model["bad"])

    def score(texts):
        measured = [sizes(t, good, bad) for t in texts]
        p = 1 / (1 + np.exp(-np.clip(inputs(measured) @ model["weights"], -30, 30)))
        return [(float(a), g, b) for a, (_, g, b) in zip(p, measured)]

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: dict | None = None, **bounds: int) -> DataFrame:
    """Probability that a text is good, for every whole text.

    Reads ``doc_id`` and ``text``, and ``doc_id`` and ``quality`` of the labels; other columns are ignored. Each text is
    compressed in blocks with a zstandard dictionary of good text and with one of bad text. The difference of the two sizes
    over their sum, with the degree of compression beside it, is turned into a probability by a logistic fit on labelled
    texts that neither dictionary has seen. The fit reads a bounded sample (``rows_per_class``, ``max_chars``).

    Null texts count as empty and get a score as well; without labels of both classes every score is 0.5. Null labels are
    left out, of repeated labels the larger holds. Repeated rows give repeated results; an empty table gives none.
    """
    model = model or train(docs, labels, **bounds)

    def start():
        score = scorer(model)

        def work(batch):
            rows = score(texts_of(batch))
            yield {
                "doc_id": batch.column(0), "score": [r[0] for r in rows], "predicted": [int(r[0] >= threshold) for r in rows],
                "good_bytes": [r[1] for r in rows], "bad_bytes": [r[2] for r in rows],
            }

        return work

    out = scan(docs, ["doc_id", "text"], SCHEMA, start)
    return out.withColumn("held_out", held_out(out["doc_id"]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds: int) -> DataFrame:
    """The rows, with all their columns, whose text scores at least ``threshold``; without a model all rows stay."""
    model = train(docs, labels, **bounds)
    if model is None:
        return docs

    def run(batches):
        score = scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([r[0] >= threshold for r in score(texts_of(batch))], pa.bool_()))

    ship_package(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
