"""Repeated passages: windows of words seen in an earlier document, found by anchors at the positions of a difference cover."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, scan, texts_of

WINDOW = 13
#: Every difference modulo PERIOD is a difference of two members of COVER, so two equal windows share an anchor at members of both.
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text whose anchors are compared in one bucket; the number of buckets grows with the input.
BUCKET_BYTES = 8_000_000
#: Keys that a task gathers before it hands them on.
BLOCK_KEYS = 600_000
PIECE_BYTES = 1 << 22

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
OF_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
OF_PLACE = [mix64(np.array([k + 1000], np.uint64))[0] | np.uint64(1) for k in range(64)]
OF_PLACE_2 = [mix64(np.array([k + 5000], np.uint64))[0] | np.uint64(1) for k in range(64)]

KEYS = "bucket: int, known: boolean, docs: binary, counts: binary, keys: binary, places: binary"


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, made as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            steps = np.full(n, BASE)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps = np.full(n, INVERSE)
            steps[0] = 1
            self.down = np.multiply.accumulate(steps)
        return self.up, self.down


POWERS = Powers()
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word, from running sums over the bytes; very long texts are taken in pieces that end between words."""
    out, at = [], 0
    while at < len(raw):
        end = len(raw)
        if end - at > PIECE_BYTES:
            end = at + PIECE_BYTES
            while end < len(raw) and not IS_SPACE[raw[end]]:
                end += 1
        piece = np.frombuffer(raw, np.uint8, end - at, at)
        inside = ~IS_SPACE[piece]
        edges = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        up, down = POWERS.upto(len(piece))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(OF_BYTE[piece] * up[: len(piece)])))
        out.append(mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def runs(words: np.ndarray, size: int, factors: list) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += words[k : k + n] * factors[k]
    return mix64(out)


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the cover, and the hashes of the anchors there."""
    n = len(words) - ANCHOR + 1
    if len(words) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n)
    at = at[np.isin(at % PERIOD, COVER)]
    return at, runs(words, ANCHOR, OF_PLACE)[at]


def low48(h: np.ndarray) -> np.ndarray:
    return h & np.uint64((1 << 48) - 1)


def pack(h: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def unpack(raw: bytes, size: int) -> np.ndarray:
    wide = np.zeros((len(raw) // size, 8), np.uint8)
    wide[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return wide.view("<u8").ravel()


class Block:
    """Keys of many documents, handed on by bucket with equal keys of the block folded."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.docs, self.first, self.second, self.places, self.held = [], [], [], [], 0

    def add(self, doc: int, first: np.ndarray, second: np.ndarray | None, places: np.ndarray | None) -> None:
        if len(first):
            self.docs.append(doc)
            self.first.append(first)
            self.second.append(second)
            self.places.append(places)
            self.held += len(first)

    def rows(self, with_places: bool):
        """Record columns. A key that several documents of the block hold goes on from its least document only; ``known`` rows
        tell what the block already knows: anchors that are shared (without places), or places of windows with a smaller holder.
        """
        if not self.docs:
            return
        docs = np.repeat(np.array(self.docs, np.int64), [len(x) for x in self.first])
        first = np.concatenate(self.first)
        second = np.concatenate(self.second) if with_places else first
        places = np.concatenate(self.places) if with_places else np.zeros(len(first), np.uint32)
        order = np.lexsort((docs, second, first)) if with_places else np.lexsort((docs, first))
        docs, first, second, places = docs[order], first[order], second[order], places[order]
        new_key = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        key = np.cumsum(new_key) - 1
        least = docs[new_key][key]
        is_least = docs == least
        if with_places:
            sent, known = is_least, ~is_least
        else:
            new_pair = new_key | np.concatenate(([True], docs[1:] != docs[:-1]))
            many = np.bincount(key, new_pair)[key] > 1
            sent, known = new_key, new_pair & many
        bucket = ((first >> np.uint64(48)) % np.uint64(self.buckets)).astype(np.int64)
        for mark, some in ((False, sent), (True, known)):
            at = np.flatnonzero(some)
            if not len(at):
                continue
            # what is known needs no comparison: it travels in one bucket for each document
            to = np.where(known, docs % self.buckets, bucket) if mark else bucket
            at = at[np.lexsort((places[at], docs[at], to[at]))]
            cuts = np.flatnonzero(np.diff(to[at])) + 1
            for part in np.split(at, cuts):
                d, counts = np.unique(docs[part], return_counts=True)
                keys = pack(first[part], 8) + pack(second[part], 4) if with_places else pack(low48(first[part]), 6)
                yield int(to[part[0]]), mark, d.tobytes(), counts.astype(np.uint32).tobytes(), keys, places[part].tobytes() if with_places else b""
        self.clear()


def columns(rows) -> dict:
    names = ("bucket", "known", "docs", "counts", "keys", "places")
    got = list(rows)
    return {n: [r[i] for r in got] for i, n in enumerate(names)}


def raw_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def anchor_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """Anchors of all documents by bucket."""

    def start():
        block = Block(buckets)

        def work(batch):
            ids = batch.column(0).to_pylist()
            for doc, text in zip(ids, texts_of(batch)):
                if doc is not None:
                    block.add(doc, anchors(word_hashes(raw_of(text)))[1], None, None)
                if block.held >= BLOCK_KEYS:
                    yield columns(block.rows(False))
            if block.held:
                yield columns(block.rows(False))

        return work

    return scan(docs, ["doc_id", "text"], KEYS, start)


def decoded(table: pa.Table, with_places: bool):
    """Documents, first and second keys, places and whether already known, key by key, of all rows of a bucket."""
    docs, first, second, places, known = [], [], [], [], []
    for mark, d, c, k, p in zip(*(table.column(n).to_pylist() for n in ("known", "docs", "counts", "keys", "places"))):
        counts = np.frombuffer(c, np.uint32)
        docs.append(np.repeat(np.frombuffer(d, np.int64), counts))
        n = int(counts.sum())
        first.append(unpack(k[: 8 * n], 8) if with_places else unpack(k, 6))
        second.append(unpack(k[8 * n :], 4) if with_places else np.zeros(0, np.uint64))
        places.append(np.frombuffer(p, np.uint32))
        known.append(np.full(n, mark))
    return [np.concatenate(x) for x in (docs, first, second, places, known)]


REPLY = "home int, docs binary, counts binary, found binary"


def replies(docs: np.ndarray, values: np.ndarray, size: int, homes: int) -> pa.Table:
    """What a bucket has found, a row for each home of documents, so that rows follow homes and not documents times buckets."""
    home = (mix64(docs.view(np.uint64)) % np.uint64(homes)).astype(np.int64)
    order = np.lexsort((docs, home))
    home, docs, values = home[order], docs[order], values[order]
    rows = [(int(home[part[0]]), *np.unique(docs[part], return_counts=True), values[part]) for part in np.split(np.arange(len(docs)), np.flatnonzero(np.diff(home)) + 1) if len(part)]
    cells = [[r[0] for r in rows], [r[1].tobytes() for r in rows], [r[2].astype(np.uint32).tobytes() for r in rows], [pack(r[3].astype(np.uint64), size) for r in rows]]
    return pa.table([pa.array(cells[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cells[1:])], names=["home", "docs", "counts", "found"])


def by_document(found: DataFrame, size: int, name: str) -> DataFrame:
    """``doc_id`` and all that the buckets have found for it, in one row."""

    def merge(table: pa.Table) -> pa.Table:
        docs, values = [], []
        for d, c, v in zip(*(table.column(n).to_pylist() for n in ("docs", "counts", "found"))):
            docs.append(np.repeat(np.frombuffer(d, np.int64), np.frombuffer(c, np.uint32)))
            values.append(unpack(v, size))
        docs, values = np.concatenate(docs), np.concatenate(values)
        order = np.argsort(docs, kind="stable")
        ids, at = np.unique(docs[order], return_index=True)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), name: pa.array([pack(x, size) for x in np.split(values[order], at[1:])], pa.binary())})

    return found.groupBy("home").applyInArrow(merge, f"doc_id bigint, {name} binary")


def shared_anchors(rows: DataFrame, homes: int) -> DataFrame:
    """``doc_id``, ``shared``: the anchors of each document that another document holds as well."""

    def compare(table: pa.Table) -> pa.Table:
        docs, keys, _, _, known = decoded(table, False)
        fresh = np.flatnonzero(~known)
        order = fresh[np.argsort(keys[fresh], kind="stable")]
        same = keys[order[1:]] == keys[order[:-1]]
        shared = known.copy()
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        return replies(docs[shared], keys[shared], 6, homes)

    return by_document(rows.groupBy("bucket").applyInArrow(compare, REPLY), 6, "shared")


def window_rows(joined: DataFrame, buckets: int) -> DataFrame:
    """Around each shared anchor, the windows it lies in, with 96 bits of hash."""

    def start():
        block = Block(buckets)

        def work(batch):
            texts = batch.column(1)
            for i, (doc, shared) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if doc is None or not shared:
                    continue
                words = word_hashes(raw_of(texts[i].as_py()))
                at, keys = anchors(words)
                at = at[np.isin(low48(keys), unpack(shared, 6))]
                n = len(words) - WINDOW + 1
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, np.maximum(at - PERIOD + 1, 0), 1)
                np.add.at(change, at + 1, -1)
                starts = np.flatnonzero(np.cumsum(change)[:n] > 0)
                first, second = runs(words, WINDOW, OF_PLACE)[starts], runs(words, WINDOW, OF_PLACE_2)[starts]
                block.add(doc, first, second >> np.uint64(32), starts.astype(np.uint32))
                if block.held >= BLOCK_KEYS:
                    yield columns(block.rows(True))
            if block.held:
                yield columns(block.rows(True))

        return work

    return scan(joined, ["doc_id", "text", "shared"], KEYS, start)


def later_windows(rows: DataFrame, homes: int) -> DataFrame:
    """``doc_id``, ``starts``: the windows of each document that a smaller document holds."""

    def compare(table: pa.Table) -> pa.Table:
        docs, first, second, places, known = decoded(table, True)
        fresh = np.flatnonzero(~known)
        order = fresh[np.lexsort((docs[fresh], second[fresh], first[fresh]))]
        later = known.copy()
        if len(order):
            new = np.concatenate(([True], (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])))
            later[order] = docs[order] > docs[order][new][np.cumsum(new) - 1]
        return replies(docs[later], places[later], 4, homes)

    return by_document(rows.groupBy("bucket").applyInArrow(compare, REPLY), 4, "starts")


RESULT = "doc_id: bigint, n_words: bigint, n_removed: bigint, kept_sha256: string"


def remove_repeats(docs: DataFrame, with_text: bool = False, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Removes every word inside a window of 13 words whose sequence also starts in a document with a smaller id.

    Reads ``doc_id`` and ``text``; other columns are ignored. Words are runs without ASCII white space, unchanged. Anchors of 7 words are hashed only
    at positions of a difference cover modulo 7. Two equal windows share an anchor at the same offset, so documents without shared
    anchors have no equal windows. Around shared anchors the match is extended: the windows that hold them are compared by 96 bits of
    hash, and those with a smaller holder are removed. Windows are judged on the input. ``with_text`` adds the kept words, joined by
    one space.

    Keys travel in blocks by hash bucket, the buckets grow in number with the input, and equal keys of a block are folded first, so a passage
    in a third of all documents reaches its bucket once for each block. Texts are shuffled once.
    Null and empty texts have no words. Documents with a null id keep all words and remove none elsewhere. Rows of equal id are one document's:
    they do not remove each other's words, and words are removed at the same places in each. An empty table gives none.
    """
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(spread, -(-total // bucket_bytes))
    shared = shared_anchors(anchor_rows(docs, buckets), buckets)
    marks = later_windows(window_rows(docs.join(shared, "doc_id", "left"), buckets), buckets)

    def start():
        def work(batch):
            out = {"doc_id": batch.column(0), "n_words": [], "n_removed": [], "kept_sha256": []} | ({"kept": []} if with_text else {})
            texts = batch.column(1)
            for i, starts in enumerate(batch.column(2).to_pylist()):
                words = raw_of(texts[i].as_py()).split()
                kept = words
                if starts:
                    at = unpack(starts, 4).astype(np.int64)
                    change = np.zeros(max(len(words), int(at.max()) + WINDOW) + 1, np.int64)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + WINDOW, -1)
                    gone = np.cumsum(change)[: len(words)] > 0
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                joined = b" ".join(kept)
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    out["kept"].append(joined.decode("utf-8", "surrogatepass"))
            yield out

        return work

    return scan(docs.join(marks, "doc_id", "left"), ["doc_id", "text", "starts"], RESULT + (", kept: string" if with_text else ""), start)


def oracle(window: int = WINDOW) -> str:
    """The digest columns in DuckDB SQL, with all windows compared as they are; ids must be unique and not null."""
    return rf"""WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    windows AS (SELECT doc_id, pos, md5(array_to_string(w[pos:pos + {window} - 1], ' ')) AS run FROM (
      SELECT doc_id, w, unnest(range(1, len(w) - {window} + 2)) AS pos FROM doc)),
    later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY run) AS holder FROM windows) WHERE doc_id > holder),
    gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {window})) AS i FROM later),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM (
      SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM doc) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
    counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM doc LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)"""
