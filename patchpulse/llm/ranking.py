"""Ranked lexical search: impact-sorted lists read in sequence, with a lower and an upper score for each document (NRA)."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import save_table
from .common import scan
from .suffixes import binary

TOP = 20
#: Bytes of item texts whose terms are looked up at once; more items are answered block by block.
BLOCK_BYTES = 4_000_000
#: Documents whose lists are read together.
SHARD_DOCS = 8_192
#: Postings that are read of each list before intervals are looked at for the first time; each later step reads twice as many.
FIRST_DEPTH = 64
#: Bytes of one text that are split into terms at a time.
PIECE_BYTES = 1 << 20

#: Terms are runs of ASCII letters and digits and of all other characters; only A to Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(raw: bytes):
    """Terms of a text, in parts that end between terms."""
    at = 0
    while at < len(raw):
        part = raw[at : at + PIECE_BYTES].translate(FOLD)
        end = at + len(part)
        if end < len(raw) and part[-1] != 32:
            space = part.rfind(b" ")
            while space < 0 and end < len(raw):  # one term longer than a piece
                more = raw[end : end + PIECE_BYTES].translate(FOLD)
                stop = more.find(b" ")
                part, end = part + (more if stop < 0 else more[:stop]), end + (len(more) if stop < 0 else stop)
                if stop >= 0:
                    break
            if space >= 0:
                part, end = part[:space], at + space + 1
        yield part.split()
        at = end


VECTOR = "doc_id: bigint, n: bigint, terms: binary, counts: binary"


def vectors(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """For each document its number of terms, and which of the wanted terms it holds how often."""

    def start():
        def work(batch):
            out = {"doc_id": batch.column(0), "n": [], "terms": [], "counts": []}
            for raw in binary(batch, "text"):
                n, found = 0, Counter()
                for words in terms_of(raw or b""):
                    n += len(words)
                    found.update(filter(number.__contains__, words))
                out["n"].append(n)
                out["terms"].append(np.array([number[w] for w in found], np.uint32).tobytes())
                out["counts"].append(np.array(list(found.values()), np.uint32).tobytes())
            yield out

        return work

    return scan(docs, ["doc_id", "text"], VECTOR, start)


def holders(index: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term."""

    def start():
        def work(batch):
            held = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32)
            count = np.bincount(held, minlength=terms)
            at = np.flatnonzero(count)
            yield {"term": at, "n": count[at]}

        return work

    out = np.zeros(terms, np.int64)
    for r in scan(index, ["terms"], "term: int, n: bigint", start).groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["term"]] = r["n"]
    return out


class Lists:
    """Impact-sorted lists of the documents of a shard: for each term its documents, those of the highest impact first."""

    def __init__(self, m: np.ndarray, terms: list[bytes], counts: list[bytes], vocabulary: int):
        self.docs = len(m)
        held = np.frombuffer(b"".join(terms), np.uint32).astype(np.uint64)
        tf = np.frombuffer(b"".join(counts), np.uint32).astype(np.int64)
        doc = np.repeat(np.arange(len(m)), [len(t) // 4 for t in terms])
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])  # below 1,000,000
        packed = np.sort((held << np.uint64(40)) | ((1_000_000 - impact).astype(np.uint64) << np.uint64(20)) | doc.astype(np.uint64))
        self.doc = (packed & np.uint64((1 << 20) - 1)).astype(np.int64)
        self.impact = 1_000_000 - ((packed >> np.uint64(20)) & np.uint64((1 << 20) - 1)).astype(np.int64)
        self.at = np.searchsorted(packed >> np.uint64(40), np.arange(vocabulary + 1, dtype=np.uint64))

    def best(self, terms: list[int], weights: list[int], top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that can be among the ``top``, with final scores; none that score 0 or below ``floor``.

        Lists are read in step. A document's lower score sums what was read of it; its upper score adds, for each list in which it was not
        met yet, the last impact read there. Reading goes on until every document whose upper score reaches the lower score of
        the last place has equal bounds: then membership, ties and scores are settled.
        """
        lists = [(int(self.at[t]), int(self.at[t + 1]), w) for t, w in zip(terms, weights) if w > 0 and self.at[t + 1] > self.at[t]]
        lower = np.zeros(self.docs, np.int64)
        met = np.zeros((len(lists), self.docs), bool)
        unread = np.array([w * self.impact[a] for a, _, w in lists], np.int64)
        read, step, live = 0, FIRST_DEPTH, np.arange(self.docs)
        while True:
            for k, (a, b, w) in enumerate(lists):
                lo, hi = a + read, min(b, a + read + step)
                if lo < hi:
                    d = self.doc[lo:hi]
                    lower[d] += w * self.impact[lo:hi]
                    met[k, d] = True
                unread[k] = w * self.impact[hi - 1] if hi < b else 0
            read, step = read + step, read + step
            least = max(1, floor, int(np.partition(lower[live], len(live) - top)[len(live) - top]) if len(live) > top else 0)
            slack = unread @ ~met[:, live] if len(lists) else np.zeros(len(live), np.int64)
            stay = lower[live] + slack >= least
            live, slack = live[stay], slack[stay]
            if not slack.any():
                return live, lower[live]


def first_of(docs: np.ndarray, null: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    return np.lexsort((docs, null, -scores))[:top]


def candidates(index: DataFrame, items: list[tuple], weights: np.ndarray, documents: int, total: int, top: int) -> DataFrame:
    """The best documents of each shard for each item: the best of all are among them."""
    questions = [(i, [t for t, _ in q], [int(weights[t]) * c for t, c in q]) for i, q in enumerate(items)]
    vocabulary = len(weights)

    def start():
        floor = [0] * len(items)  # of the last place in the shards that this task has read

        def work(batch):
            ids = batch.column(0)
            null = np.array(ids.is_null().to_pylist(), bool)
            ids = np.array(ids.fill_null(0).to_pylist(), np.int64)
            n = np.array(batch.column(1).to_pylist(), np.int64)
            terms, counts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for lo in range(0, len(ids), SHARD_DOCS):
                part = slice(lo, lo + SHARD_DOCS)
                if not total:
                    continue
                lists = Lists(75 + (25 * n[part] * documents) // total, terms[part], counts[part], vocabulary)
                item, doc, score = [], [], []
                for i, wanted, factors in questions:
                    live, scores = lists.best(wanted, factors, top, floor[i])
                    best = first_of(ids[part][live], null[part][live], scores, top)
                    if len(best) == top:
                        floor[i] = max(floor[i], int(scores[best[-1]]))
                    item += [i] * len(best)
                    score += scores[best].tolist()
                    doc += [None if z else d for d, z in zip(ids[part][live][best].tolist(), null[part][live][best].tolist())]
                yield {"item": item, "doc_id": pa.array(doc, pa.int64()), "score": score}

        return work

    return scan(index, ["doc_id", "n", "terms", "counts"], "item: int, doc_id: bigint, score: bigint", start)


def search_block(docs: DataFrame, items: DataFrame, top: int) -> DataFrame | None:
    """Ranks for the items of one block; None if no item of it has a term."""
    spark = docs.sparkSession
    asked = sorted((tuple(r) for r in items.select("item_id", "text").collect()), key=lambda r: (r[0] is None, r[0], r[1] or ""))
    bags = [Counter(w for words in terms_of((t or "").encode()) for w in words) for _, t in asked]
    number = {w: i for i, w in enumerate(sorted(set().union(*bags)))}
    if not number:
        return None
    index = save_table(vectors(docs, number), "vectors")
    documents, total = index.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in holders(index, len(number))], np.int64)
    found = candidates(index, [[(number[w], c) for w, c in sorted(b.items())] for b in bags], weights, documents, total or 0, top)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(asked)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
    return ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``top`` documents of each item by integer term weights.

    Reads ``doc_id`` and ``text`` of the documents, ``item_id`` and ``text`` of the items; other columns are ignored. The index holds every
    document, with its counts of the terms that any item of a block asks for (a block holds a bounded number of bytes of item texts, so
    what tasks are told is bounded; more items are answered block by block). Counts of documents and terms come from the
    whole index. Shards of a bounded number of documents have impact-sorted lists, in which each item is answered by NRA; the best of
    all shards, ``top`` for each item and task, are ranked by a window.

    Null and empty texts have no terms and never rank; items without terms have no rows. Equal scores go by document id, a null id last.
    Repeated rows, of documents or items, count and are answered as rows of their own. A very long text is split in
    pieces between terms. Empty tables give no rows.
    """
    items, docs = items.select("item_id", "text"), docs.select("doc_id", "text")
    blocks = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes
    out = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        found = search_block(docs, part, top)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        kind = items.schema["item_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return out


def oracle() -> str:
    """The same for DuckDB, term by term."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = f"unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '{TERM}'))"
    return f"""
WITH word AS (SELECT doc_id, {split} AS term FROM documents),
doc AS (SELECT doc_id, count(*) AS n FROM word GROUP BY 1),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM doc),
tf AS (SELECT doc_id, term, count(*) AS tf FROM word GROUP BY 1, 2),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {split} AS term FROM benchmark) GROUP BY 1, 2),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1) CROSS JOIN whole),
part AS (
  SELECT item_id, doc_id, times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total))) AS part
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN doc USING (doc_id) CROSS JOIN whole),
score AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM part GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0)
WHERE rank <= {TOP}
"""
