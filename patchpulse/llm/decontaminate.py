"""Benchmark decontamination: one automaton over the windows of all benchmark items, each text read once."""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import scan, ship_package, texts_of

WINDOW = 10
#: Normalised benchmark bytes in one automaton; a larger benchmark is searched by several automata, one after another.
BLOCK_BYTES = 8_000_000

#: A-Z become a-z; digits, letters and all bytes of other scripts stay; the rest separates words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SCHEMA = (
    "doc_id: bigint, n_words: bigint, n_hit: bigint, n_items: bigint, items: array<string>, items_sha256: string, "
    "contaminated: boolean, spans: array<struct<start:bigint,end:bigint>>"
)


def normalised(text: str | None) -> bytes:
    """Lower-cased words with one space around each; empty without words. Positions are bytes."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split(b" ")
    joined = b" ".join(filter(None, words))
    return b" " + joined + b" " if joined else b""


def windows(text: str | None, size: int) -> set[bytes]:
    words = normalised(text).split()
    return {b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))} if words else set()


def automaton(block: list[tuple[str, str]], size: int):
    """Finds every window; its payload has the items that hold it and its length in bytes."""
    held: dict[bytes, list[str]] = {}
    for item, text in block:
        for w in windows(text, size):
            held.setdefault(w, []).append(item)
    found = ahocorasick.Automaton()
    for w, items in held.items():
        found.add_word(w.decode("latin-1"), (len(w), items))
    if held:
        found.make_automaton()
    return found if held else None


def original_spans(text: str, hit: np.ndarray) -> list[dict]:
    """Code point spans in the original text of each run of hit words, end exclusive."""
    raw = text.encode("utf-8", "surrogatepass")
    inside = np.frombuffer(raw.translate(FOLD), np.uint8) != 32
    edges = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    runs = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    first, last = np.flatnonzero(runs == 1), np.flatnonzero(runs == -1) - 1
    return [{"start": int(points[starts[a]]), "end": int(points[ends[b]])} for a, b in zip(first, last)]


def blocks_of(benchmark: DataFrame, block_bytes: int) -> list:
    """Broadcast handles of blocks of (item, text), made one at a time so that the driver holds one block."""
    sc = benchmark.sparkSession.sparkContext
    handles, block, held = [], [], 0
    rows = benchmark.selectExpr("CAST(item_id AS STRING) AS item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    for r in rows.toLocalIterator():
        if block and held + len(r["text"]) > block_bytes:
            handles.append(sc.broadcast(block))
            block, held = [], 0
        block.append((r["item_id"], r["text"]))
        held += len(r["text"])
    return [*handles, sc.broadcast(block)] if block else handles


def finder(benchmark: DataFrame, window: int, block_bytes: int):
    """Makes, once in a task, the function from texts to (normalised text, [(start, end, items)]) in bytes of the normalised text."""
    handles = blocks_of(benchmark, block_bytes)

    def start():
        built: dict[int, object] = {}

        def machine(k: int):
            if k not in built:
                if len(handles) > 1:
                    built.clear()
                built[k] = automaton(handles[k].value, window)
            return built[k]

        def hits_of(texts):
            plain = [normalised(t) for t in texts]
            found: list[list[tuple[int, int, list[str]]]] = [[] for _ in texts]
            for k in range(len(handles)):
                if (m := machine(k)) is not None:
                    for i, p in enumerate(plain):
                        if p:
                            found[i] += [(end - n + 1, end, items) for end, (n, items) in m.iter(p.decode("latin-1"))]
            return zip(plain, found)

        return hits_of

    return start


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Which words of each whole text lie inside a window of a benchmark item.

    Reads ``doc_id``, ``text`` of ``docs`` and ``item_id``, ``text`` of ``benchmark``; other columns are ignored. Words are runs
    of ASCII letters, digits and other scripts, lower-cased in A-Z. An item's windows are its runs of ``window`` words, or the
    whole item if it is shorter. All windows of a block of items form one Aho-Corasick automaton, built once in each
    task; a text is scanned once for each block, from beginning to end. Overlapping occurrences all count. ``spans`` are code
    points of the original text. One block holds at most ``block_bytes``, so memory does not grow with the benchmark.

    Null and empty texts have no words and no hits; items without words match nothing, null item ids are left out, and
    repeated items count once. Repeated document rows give repeated results; empty tables give no rows or no hits.
    """
    find = finder(benchmark, window, block_bytes)

    def start():
        hits_of = find()

        def work(batch):
            texts = texts_of(batch)
            out = {k: [] for k in ("n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "spans")}
            for text, (p, hits) in zip(texts, hits_of(texts)):
                n = p.count(b" ") - 1 if p else 0
                hit, items = np.zeros(n, bool), []
                if hits:
                    gaps = np.flatnonzero(np.frombuffer(p, np.uint8) == 32)
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, np.searchsorted(gaps, [h[0] for h in hits]), 1)
                    np.add.at(change, np.searchsorted(gaps, [h[1] for h in hits]), -1)
                    hit = np.cumsum(change)[:n] > 0
                    items = sorted({x for h in hits for x in h[2]})
                out["n_words"].append(n)
                out["n_hit"].append(int(hit.sum()))
                out["n_items"].append(len(items))
                out["items"].append(items)
                out["items_sha256"].append(hashlib.sha256(",".join(items).encode()).hexdigest())
                out["contaminated"].append(bool(hits))
                out["spans"].append(original_spans(text, hit) if hits else [])
            yield {"doc_id": batch.column(0)} | out

        return work

    return scan(docs, ["doc_id", "text"], SCHEMA, start)


def clean_only(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows, with all their columns, whose text holds no window of any item."""
    find = finder(benchmark, window, block_bytes)

    def run(batches):
        hits_of = find()
        for batch in batches:
            yield batch.filter(pa.array([not hits for _, hits in hits_of(texts_of(batch))], pa.bool_()))

    ship_package(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def oracle(window: int = WINDOW) -> str:
    """The digest columns in DuckDB SQL: windows of items joined with runs of as many words in the documents."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = "SELECT {0}, {1} AS n, unnest(range(1, len(w) - {1} + 2)) AS pos, w FROM {2}"
    return f"""WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
    item AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
    sized AS (SELECT item_id, w, least(len(w), {window}) AS size FROM item WHERE len(w) > 0),
    wanted AS (SELECT DISTINCT item_id, n, array_to_string(w[pos:pos + n - 1], ' ') AS run FROM ({runs.format("item_id", "size", "sized")})),
    lengths AS (SELECT DISTINCT n AS size FROM wanted),
    held AS (SELECT r, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS run FROM ({runs.format("r", "size", "doc JOIN lengths ON len(w) >= size")})),
    hit AS (SELECT r, n, pos, item_id FROM held JOIN wanted USING (n, run)),
    hit_words AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS i FROM hit) GROUP BY r),
    hit_items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
      n_hit IS NOT NULL AS contaminated FROM doc LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)"""
