"""Repeated byte strings: suffix arrays of shards, common prefixes of neighbours, and shards merged by binary search."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, scan
from .substrings import OF_BYTE, POWERS, low48, pack, unpack

LENGTH = 400
#: Of the REACH grams of GRAM bytes in each string of 400 bytes the one of the least hash is its anchor.
GRAM = 320
REACH = LENGTH - GRAM + 1
#: Bits of a position in a shard: a group, a rank and a position fill one 63-bit number, which is sorted as it is.
PLACE_BITS = 21
SHARD_BYTES = (1 << PLACE_BITS) - 1
#: Zero bytes between the parts of a shard.
GAP = 8
#: Bytes of text whose strings meet in one bucket (their anchors, which are few, meet three times as many); the number of buckets grows with the input.
BUCKET_BYTES = 16_000_000
BLOCK_KEYS = 400_000
PIECE_BYTES = 1 << 20
#: Bytes of the SHA-256 of a text by which it is known.
KEY = 16
OF_BYTE_2 = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
OPEN, CLOSED, KNOWN = 0, 1, 2


def suffix_array(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of the parts ``[starts, ends)`` of ``codes``, in order.

    Codes of the parts are above 0 and the GAP codes after each part are 0. A suffix ends with its part, and equal suffixes are ordered by
    part. Larsson and Sadakane: suffixes are sorted by their first symbols, then the groups that are still tied are
    sorted by the rank of what follows, which doubles the compared length in each round; settled suffixes are not touched again.
    """
    n = len(codes)
    bits = max(1, int(codes.max()).bit_length()) if n else 1
    depth = min(GAP, (64 - PLACE_BITS) // bits)
    wide = np.concatenate((codes, np.zeros(GAP, codes.dtype))).astype(np.uint64)
    low = np.uint64(SHARD_BYTES)
    key = np.zeros(n, np.uint64)
    for k in range(depth):
        key = (key << np.uint64(bits)) | wide[k : n + k]
    live = np.flatnonzero(codes)
    packed = np.sort((key[live] << np.uint64(PLACE_BITS)) | live.astype(np.uint64))
    order = (packed & low).astype(np.int64)
    packed >>= np.uint64(PLACE_BITS)
    first = np.concatenate(([True], packed[1:] != packed[:-1])) if len(order) else np.zeros(0, bool)
    rank = np.zeros(n, np.int64)
    head = np.flatnonzero(first)
    rank[order] = head[np.cumsum(first) - 1] if len(order) else 0
    part = np.zeros(n + 1, np.int64)
    part[starts] = 1
    part = np.cumsum(part[:n]) - 1
    slots = np.flatnonzero(~(first & np.concatenate((first[1:], [True])))) if len(order) else np.zeros(0, np.int64)
    while len(slots):
        at = order[slots]
        group, own = rank[at], part[at]
        beyond = at + depth >= ends[own]
        second = np.where(beyond, own, rank[np.minimum(at + depth, n - 1)] + len(starts))
        packed = (group.astype(np.uint64) << np.uint64(2 * PLACE_BITS)) | (second.astype(np.uint64) << np.uint64(PLACE_BITS)) | np.arange(len(at), dtype=np.uint64)
        packed.sort()
        at = at[(packed & low).astype(np.int64)]
        packed >>= np.uint64(PLACE_BITS)
        order[slots] = at
        first = np.concatenate(([True], packed[1:] != packed[:-1]))
        rank[at] = slots[np.flatnonzero(first)[np.cumsum(first) - 1]]
        slots = slots[~(first & np.concatenate((first[1:], [True])))]
        depth *= 2
    return order


def common_prefixes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix in order, the length of its common prefix with the one before it.

    Kasai's rule: where the symbols before two neighbours are equal, the common prefix is one shorter than that of the position
    before, so only the other positions are compared; the lengths of the rest follow from them by counting down.
    """
    n = len(codes)
    if not len(order):
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    part = np.zeros(n + 1, np.int64)
    part[starts] = 1
    part = np.cumsum(part[:n]) - 1
    live = np.flatnonzero(codes)
    other = before[live]
    prior = np.concatenate((np.zeros(1, codes.dtype), codes[:-1]))
    fresh = (other < 0) | (prior[live] == 0) | (prior[live] != prior[np.maximum(other, 0)])
    mine, theirs = live[fresh], other[fresh]
    length = np.zeros(len(mine), np.int64)
    padded = np.concatenate((codes, np.zeros(2 * GAP, codes.dtype)))
    eight = np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))
    most = np.where(theirs < 0, 0, np.minimum(ends[part[mine]] - mine, ends[part[np.maximum(theirs, 0)]] - theirs))
    going = np.flatnonzero(most > 0)
    while len(going):
        at = length[going]
        differ = eight[mine[going] + at] ^ eight[theirs[going] + at]
        same = np.zeros(len(going), np.int64)
        for k in range(1, 8):
            same += (differ & np.uint64((1 << (8 * k)) - 1)) == 0
        whole = differ == 0
        length[going] = np.minimum(at + np.where(whole, 8, same), most[going])
        going = going[whole & (length[going] < most[going])]
    of_place = np.zeros(n, np.int64)
    anchor = np.maximum.accumulate(np.where(fresh, np.arange(len(live)), 0))
    spread = np.zeros(len(live), np.int64)
    spread[fresh] = length
    of_place[live] = spread[anchor] - (live - live[anchor])
    return of_place[order]


def merged(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs merged two by two: each element finds its place in the other run by binary search. Returns keys and where they stood."""
    at = np.cumsum([0, *(len(r) for r in runs)])
    parts = [(r, np.arange(a, a + len(r))) for r, a in zip(runs, at)]
    while len(parts) > 1:
        joined = []
        for (x, ix), (y, iy) in zip(parts[::2], parts[1::2]):
            keys, place = np.empty(len(x) + len(y), x.dtype), np.empty(len(x) + len(y), np.int64)
            px = np.arange(len(x)) + np.searchsorted(y, x, "left")
            py = np.arange(len(y)) + np.searchsorted(x, y, "right")
            keys[px], keys[py], place[px], place[py] = x, y, ix, iy
            joined.append((keys, place))
        parts = joined + ([parts[-1]] if len(parts) % 2 else [])
    return parts[0]


def sliding(f, x: np.ndarray, size: int) -> np.ndarray:
    """``f`` (minimum or maximum) over each run of ``size`` values."""
    have = 1
    while have < size:
        step = min(have, size - have)
        x = f(x[: len(x) - step], x[step:])
        have += step
    return x


def sums_of(raw: np.ndarray, of_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = POWERS.upto(len(raw) + 1)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(of_byte[raw] * up[: len(raw)]))), down


def grams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and for each string of LENGTH bytes the least hash of its grams: its anchor."""
    n = len(raw) - GRAM + 1
    if len(raw) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sums, down = sums_of(raw, OF_BYTE)
    h = mix64((sums[GRAM:] - sums[:-GRAM]) * down[:n])
    return h, sliding(np.minimum, h, REACH)


def anchors(raw: np.ndarray) -> np.ndarray:
    """Hashes of the anchors of all strings, once for each place."""
    h, least = grams(raw)
    edge = np.zeros(REACH - 1, np.uint64)
    return h[sliding(np.maximum, np.concatenate((edge, least, edge)), REACH) == h] if len(h) else h


def pieces(size: int):
    """Parts of a text that hold each of its strings once: they overlap by one byte less than a string."""
    for at in range(0, max(size - LENGTH + 1, 0), PIECE_BYTES):
        yield at, min(size, at + PIECE_BYTES + LENGTH - 1)


NARROW, WIDE = np.dtype("<u2"), np.dtype("<u4")
ROWS = "bucket: int, kind: int, docs: binary, counts: binary, keys: binary, places: binary"


def cut(kind: int, bucket: np.ndarray, owner: np.ndarray, names: np.ndarray, key_bytes, places):
    """Rows by bucket from entries ordered by bucket and key: ``docs`` are the texts, ``places`` the number of the text for each key."""
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for part in np.split(np.arange(len(bucket)), edges):
        if len(part):
            used, number = np.unique(owner[part], return_inverse=True)
            yield int(bucket[part[0]]), kind, names[used].tobytes(), number.astype(NARROW if len(used) < 1 << 16 else WIDE).tobytes(), key_bytes(part), places(part)


def columns(rows) -> dict:
    got = list(rows)
    return {n: [r[i] for r in got] for i, n in enumerate(("bucket", "kind", "docs", "counts", "keys", "places"))}


def binary(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes, without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64)


def anchor_rows(texts: DataFrame, buckets: int) -> DataFrame:
    """Anchors of all texts by bucket. Anchors that several texts of a block hold (or a text with copies) are known at once."""

    def start():
        held: list = []

        def flush():
            owner = np.repeat(np.arange(len(held)), [len(x[2]) for x in held])
            keys = np.concatenate([x[2] for x in held])
            names = np.array([x[0] for x in held], f"S{KEY}")
            many = np.array([x[1] for x in held])
            order = np.lexsort((owner, keys))
            keys, owner = keys[order], owner[order]
            first = np.concatenate(([True], keys[1:] != keys[:-1]))
            group = np.cumsum(first) - 1
            several = (np.bincount(group) > 1) | (np.bincount(group, many[owner]) > 0)
            held.clear()
            for kind, at in ((OPEN, first & ~several[group]), (CLOSED, first & several[group]), (KNOWN, several[group])):
                at = np.flatnonzero(at)
                bucket = owner[at] % buckets if kind == KNOWN else bucket_of(keys[at], buckets)
                order = np.lexsort((low48(keys[at]), bucket))
                at, bucket = at[order], bucket[order]
                yield from cut(kind, bucket, owner[at], names, lambda p, at=at: pack(low48(keys[at[p]]), 6), lambda p: b"")

        def work(batch):
            size = 0
            for key, raw, many in zip(batch.column(0).to_pylist(), binary(batch, "text"), batch.column(2).to_pylist()):
                data = np.frombuffer(raw, np.uint8)
                found = [anchors(data[a:b]) for a, b in pieces(len(data))]
                if found:
                    # a string that a text repeats has its anchors at two places, which may lie in two pieces
                    held.append((key, many, np.concatenate([repeated_once(x) for x in found])))
                    size += len(held[-1][2])
                if size >= BLOCK_KEYS:
                    size = 0
                    yield columns(flush())
            if held:
                yield columns(flush())

        return work

    return scan(texts, ["key", "text", "many"], ROWS, start)


def repeated_once(keys: np.ndarray) -> np.ndarray:
    """Each key once if it stands once, else twice."""
    k, c = np.unique(keys, return_counts=True)
    return np.repeat(k, np.minimum(c, 2))


REPLY = "home int, kind int, docs binary, counts binary, found binary"


def replies(kind: int, docs: np.ndarray, found: np.ndarray, size: int, homes: int) -> list[tuple]:
    """Answers by home of texts: ``found`` (``size`` bytes each) belongs to the text in ``docs``."""
    if not len(docs):
        return []
    names, number = np.unique(docs, return_inverse=True)
    home = np.frombuffer(names.astype(f"S{KEY}").tobytes(), "<u4")[:: KEY // 4].astype(np.int64) % homes
    order = np.lexsort((number, home[number]))
    number, found = number[order], found[order]
    cuts = np.flatnonzero(np.diff(home[number])) + 1
    rows = []
    for part in np.split(np.arange(len(number)), cuts):
        used, counts = np.unique(number[part], return_counts=True)
        rows.append((int(home[used[0]]), kind, names[used].tobytes(), counts.astype(np.uint32).tobytes(), pack(found[part].astype(np.uint64), size)))
    return rows


def reply_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    names = ("home", "kind", "docs", "counts", "found")
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))


def entries(table: pa.Table, kinds: tuple):
    """Runs of a bucket: kind, text of each key, keys and places as bytes."""
    for kind, d, c, k, p in zip(*(table.column(n).to_pylist() for n in ("kind", "docs", "counts", "keys", "places"))):
        if kind in kinds:
            names = np.frombuffer(d, f"S{KEY}")
            yield kind, names[np.frombuffer(c, NARROW if len(names) < 1 << 16 else WIDE)], k, p


def shared_anchors(rows: DataFrame, homes: int) -> DataFrame:
    """Anchors that stand at two places at least, by text."""

    def compare(table: pa.Table) -> pa.Table:
        runs = [(kind, docs, unpack(k, 6)) for kind, docs, k, _ in entries(table, (OPEN, CLOSED))]
        out = [r for _, docs, k, _ in entries(table, (KNOWN,)) for r in replies(KNOWN, docs, unpack(k, 6), 6, homes)]
        if runs:
            keys, at = merged([r[2] for r in runs])
            same = np.zeros(len(keys) + 1, bool)
            same[1:-1] = keys[1:] == keys[:-1]
            hit = np.zeros(len(keys), bool)
            hit[at] = same[1:] | same[:-1]
            is_open = np.concatenate([np.full(len(r[2]), r[0] == OPEN) for r in runs])
            docs, keys = np.concatenate([r[1] for r in runs]), np.concatenate([r[2] for r in runs])
            out += replies(KNOWN, docs[hit & is_open], keys[hit & is_open], 6, homes)
        return reply_table(out)

    return rows.groupBy("bucket").applyInArrow(compare, REPLY)


def by_text(found: DataFrame, sizes: dict[int, tuple[str, int]]) -> DataFrame:
    """``key`` and, for each kind of answer, all its values in one column."""

    def merge(table: pa.Table) -> pa.Table:
        got = list(zip(*(table.column(n).to_pylist() for n in ("kind", "docs", "counts", "found"))))
        keys, cells = np.unique(np.concatenate([np.frombuffer(d, f"S{KEY}") for _, d, _, _ in got])), {}
        for kind, (name, size) in sizes.items():
            mine = [(np.repeat(np.frombuffer(d, f"S{KEY}"), np.frombuffer(c, np.uint32)), unpack(f, size)) for k, d, c, f in got if k == kind]
            docs = np.searchsorted(keys, np.concatenate([np.zeros(0, f"S{KEY}"), *(m[0] for m in mine)]))
            values = np.concatenate([np.zeros(0, np.uint64), *(m[1] for m in mine)])
            order = np.argsort(docs, kind="stable")
            cells[name] = [pack(x, size) for x in np.split(values[order], np.searchsorted(docs[order], np.arange(1, len(keys))))]
        raw = keys.astype(f"S{KEY}").tobytes()
        return pa.table({"key": pa.array([raw[i : i + KEY] for i in range(0, len(raw), KEY)], pa.binary()), **{n: pa.array(c, pa.binary()) for n, c in cells.items()}})

    return found.groupBy("home").applyInArrow(merge, "key binary, " + ", ".join(f"{n} binary" for n, _ in sizes.values()))


def candidates(raw: np.ndarray, shared: np.ndarray) -> list[tuple[int, int, int]]:
    """Parts of a text whose strings of LENGTH bytes all have a shared anchor, with the least of these; every repeated string lies in one of them."""
    _, least = grams(raw)
    if not len(least):
        return []
    turn = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    free = np.repeat(np.isin(low48(least[turn]), shared), np.diff(np.append(turn, len(least))))
    edges = np.diff(np.concatenate(([0], free.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()
    return [(a, b + LENGTH - 1, int(least[a:b].min() >> np.uint64(1))) for a, b in zip(starts, ends)]


class Shard:
    """Parts of texts side by side, and what their suffix array says of them."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.raw, self.texts, self.at, self.many, self.size = [], [], [], [], 0

    def add(self, key: bytes, many: bool, raw: np.ndarray, at: int) -> None:
        self.raw.append(raw)
        self.texts.append(key)
        self.at.append(at)
        self.many.append(many)
        self.size += len(raw) + GAP

    def rows(self):
        lengths = np.array([len(r) for r in self.raw])
        starts = np.concatenate(([0], np.cumsum(lengths + GAP)[:-1]))
        ends = starts + lengths
        body = np.zeros(self.size, np.uint8)
        inside = np.zeros(self.size + 1, np.int8)
        for r, s in zip(self.raw, starts):
            body[s : s + len(r)] = r
        inside[starts] += 1
        inside[ends] -= 1
        inside = np.cumsum(inside[:-1]).astype(bool)
        seen = np.zeros(256, np.uint8)
        used = np.flatnonzero(np.bincount(body[inside], minlength=256))
        seen[used] = np.arange(1, len(used) + 1)  # UTF-8 never uses all byte values, so 0 is free for the gaps
        codes = np.where(inside, seen[body], 0).astype(np.uint8)
        order = suffix_array(codes, starts, ends)
        prefix = common_prefixes(codes, starts, ends, order)
        part = np.repeat(np.arange(len(starts)), lengths + GAP)
        own = part[order]
        string = order + LENGTH <= ends[own]
        order, prefix, own = order[string], prefix[string], own[string]
        first = prefix < LENGTH
        if len(first):
            first[0] = True
        group = np.cumsum(first) - 1
        several = (np.bincount(group) > 1) | (np.bincount(group, np.array(self.many)[own]) > 0)
        names, at = np.array(self.texts, f"S{KEY}"), np.array(self.at)
        place = order - starts[own] + at[own]
        heads = np.flatnonzero(first)
        h = [self.hashes(body, order[heads], of_byte) for of_byte in (OF_BYTE, OF_BYTE_2)]
        for kind, pick in ((OPEN, ~several), (CLOSED, several)):
            pick = np.flatnonzero(pick)
            bucket = bucket_of(h[0][pick], self.buckets)
            pick = pick[np.lexsort((h[1][pick], h[0][pick], bucket))]
            bucket = bucket_of(h[0][pick], self.buckets)
            keys = lambda p, pick=pick: pack(h[0][pick[p]], 8) + pack(h[1][pick[p]] >> np.uint64(32), 4)
            if kind == OPEN:
                yield from cut(kind, bucket, own[heads[pick]], names, keys, lambda p, pick=pick: place[heads[pick[p]]].astype(np.uint32).tobytes())
            else:  # who holds them is known already: only the keys travel
                yield from cut(kind, bucket, np.zeros(len(pick), np.int64), names, keys, lambda p: b"")
        known = np.flatnonzero(several[group])
        known = known[np.lexsort((place[known], own[known]))]
        if len(known):
            new = np.concatenate(([True], (own[known[1:]] != own[known[:-1]]) | (place[known[1:]] != place[known[:-1]] + 1)))
            begin = known[new]
            count = np.diff(np.append(np.flatnonzero(new), len(known)))
            spans = (place[begin].astype(np.uint64) << np.uint64(32)) | count.astype(np.uint64)
            bucket = own[begin] % self.buckets
            to = np.argsort(bucket, kind="stable")
            yield from cut(KNOWN, bucket[to], own[begin[to]], names, lambda p: pack(spans[to[p]], 8), lambda p: b"")
        self.clear()

    @staticmethod
    def hashes(body: np.ndarray, at: np.ndarray, of_byte: np.ndarray) -> np.ndarray:
        sums, down = sums_of(body, of_byte)
        return mix64((sums[at + LENGTH] - sums[at]) * down[at])


PARTS = "key: binary, many: boolean, at: bigint, cluster: bigint, body: binary"


def candidate_parts(joined: DataFrame) -> DataFrame:
    """Candidate parts of all texts, each with its least anchor: copies of a passage have the same."""

    def start():
        def work(batch):
            out = {n: [] for n in ("key", "many", "at", "cluster", "body")}
            for key, raw, many, shared in zip(batch.column(0).to_pylist(), binary(batch, "text"), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                shared = unpack(shared, 6)
                data = np.frombuffer(raw, np.uint8)
                for a, b in pieces(len(data)):
                    for lo, hi, least in candidates(data[a:b], shared):
                        for n, v in zip(out, (key, many, a + lo, least, raw[a + lo : a + hi])):
                            out[n].append(v)
            yield out

        return work

    return scan(joined, ["key", "text", "many", "shared"], PARTS, start)


def string_rows(parts: DataFrame, buckets: int) -> DataFrame:
    """Suffix arrays of shards of candidate parts: one key for each distinct string of a shard, and the strings known to repeat."""

    def start():
        shard = Shard(buckets)

        def work(batch):
            for key, many, at, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                data = np.frombuffer(raw.as_py(), np.uint8)
                if shard.size and shard.size + len(data) + GAP > SHARD_BYTES:
                    yield columns(shard.rows())
                shard.add(key, many, data, at)
            if shard.size:
                yield columns(shard.rows())

        return work

    return scan(parts, ["key", "many", "at", "body"], ROWS, start)


def repeated_strings(rows: DataFrame, homes: int) -> DataFrame:
    """Runs of keys of all shards merged; strings that another shard holds go back to their text."""

    def compare(table: pa.Table) -> pa.Table:
        out = [r for _, docs, k, _ in entries(table, (KNOWN,)) for r in replies(KNOWN, docs, unpack(k, 8), 8, homes)]
        runs = []
        for kind, docs, k, p in entries(table, (OPEN, CLOSED)):
            n = len(docs)
            runs.append((kind, docs, unpack(k[: 8 * n], 8), unpack(k[8 * n :], 4), np.frombuffer(p, np.uint32) if kind == OPEN else np.zeros(n, np.uint32)))
        if runs:
            keys, at = merged([r[2] for r in runs])
            more = np.concatenate([r[3] for r in runs])[at]
            if ((keys[1:] == keys[:-1]) & (more[1:] != more[:-1])).any():  # two strings of one hash: the other hash parts them
                again = np.lexsort((more, keys))
                keys, more, at = keys[again], more[again], at[again]
            same = np.zeros(len(keys) + 1, bool)
            same[1:-1] = (keys[1:] == keys[:-1]) & (more[1:] == more[:-1])
            hit = np.zeros(len(keys), bool)
            hit[at] = same[1:] | same[:-1]
            hit &= np.concatenate([np.full(len(r[2]), r[0] == OPEN) for r in runs])
            out += replies(OPEN, np.concatenate([r[1] for r in runs])[hit], np.concatenate([r[4] for r in runs])[hit], 4, homes)
        return reply_table(out)

    return rows.groupBy("bucket").applyInArrow(compare, REPLY)


def without(raw: bytes, spans: bytes, places: bytes) -> tuple[bytes, int, int]:
    """What is left of ``raw``, how many bytes are gone and in how many runs."""
    change = np.zeros(len(raw) + 1, np.int64)
    span = unpack(spans, 8)
    begin, count = (span >> np.uint64(32)).astype(np.int64), (span & np.uint64(0xFFFFFFFF)).astype(np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + count + LENGTH - 1, -1)
    place = unpack(places, 4).astype(np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + LENGTH, -1)
    gone = np.cumsum(change)[: len(raw)] > 0
    left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return left, len(raw) - len(left), int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())


RESULT = "key: binary, n_removed: bigint, n_spans: bigint, kept_sha256: string"


def remove_repeated_bytes(docs: DataFrame, with_text: bool = False, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Removes every byte covered by a string of 400 bytes that also starts anywhere else, in the same document or another.

    Reads ``doc_id`` and ``text`` (as UTF-8); other columns are ignored. Equal texts are folded. The anchor of a string (its gram of 320
    bytes with the least hash) tells whether it can repeat at all: only if that gram stands somewhere else too.
    These parts are packed into shards, parts with the same least anchor side by side where their number allows it (Spark splits the hot ones). Each shard has a suffix array (Larsson-Sadakane refinement) and the common prefixes of neighbours
    (Kasai); neighbours with 400 bytes in common are the repeats inside the shard. One key of 96 bits for each distinct string of a shard travels in
    sorted runs, cut by hash bucket, and the runs of all shards are merged by binary search; strings of two shards are the other repeats.
    Strings are judged on the input. ``with_text`` adds the bytes that are left.

    Texts are shuffled once, in one plan that reads that shuffle three times. A passage in a third of all texts is one key for each shard, and the number of buckets and shards grows with the
    input. A text above a megabyte is taken in overlapping pieces, so a very long one needs no more memory than others, but for the row itself.
    Null and empty texts have no bytes and keep them. Documents with a null id, and rows of one id, are documents of their own: repeated
    rows remove each other's text. There are no ties. An empty table gives none.
    """
    text, short = F.coalesce("text", F.lit("")), lambda sha: F.unhex(F.substring(sha, 1, 2 * KEY))
    base = docs.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    base = base.withColumn("key", short(F.col("sha")))
    # the filter stands in every branch after its join, so it stands here too: the branches then share one shuffle
    long = docs.where(F.octet_length("text") >= LENGTH).select("text", short(F.sha2("text", 256)).alias("key")).where("key is not null")
    texts = long.groupBy("key").agg(F.min("text").alias("text"), (F.count("*") > 1).alias("many"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, few = 1 + total // bucket_bytes, 1 + total // (3 * bucket_bytes)
    shared = by_text(shared_anchors(anchor_rows(texts, few), few), {KNOWN: ("shared", 6)})
    parts = candidate_parts(texts.join(shared, "key")).hint("rebalance", "cluster").sortWithinPartitions("cluster")
    marks = by_text(repeated_strings(string_rows(parts, buckets), buckets), {KNOWN: ("spans", 8), OPEN: ("places", 4)})

    def start():
        def work(batch):
            out = {n: [] for n in ("key", "n_removed", "n_spans", "kept_sha256", *(["kept"] * with_text))}
            for key, raw, spans, places in zip(batch.column(0).to_pylist(), binary(batch, "text"), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                left, removed, runs = without(raw, spans, places)
                for n, v in zip(out, (key, removed, runs, hashlib.sha256(left).hexdigest(), left)):
                    out[n].append(v)
            yield out

        return work

    # all columns of the texts are read, as pruning one would part this branch from the shuffle of the others
    cut_texts = scan(texts.join(marks, "key"), ["key", "text", "many", "spans", "places"], RESULT + ", kept: binary" * with_text, start)
    out = base.join(cut_texts, "key", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("bigint")).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        *(["kept", "key"] * with_text),
    )
    if with_text:
        whole = docs.select(short(F.sha2(text, 256)).alias("key"), text.cast("binary").alias("whole")).groupBy("key").agg(F.min("whole").alias("whole"))
        out = out.join(whole, "key").withColumn("kept", F.coalesce("kept", "whole")).drop("key", "whole")
    return out


def oracle(length: int = LENGTH, chunk: int = 256) -> str:
    """The result in DuckDB SQL, with every string of ``length`` bytes compared by its MD5; bytes are pairs of hexadecimal digits, and texts
    are cut into overlapping chunks so that a string is short to cut out."""
    return f"""WITH doc AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    chunks AS (SELECT r, c, least({chunk}, CAST(length(h) // 2 AS BIGINT) - {length} + 1 - c * {chunk}) AS n, h[2 * {chunk} * c + 1 : 2 * ({chunk} * c + {chunk + length - 1})] AS part
      FROM (SELECT r, h, unnest(range(0, CAST(ceil((length(h) // 2 - {length} + 1) / {chunk}) AS BIGINT))) AS c FROM doc)),
    starts AS (SELECT r, c * {chunk} + s AS s, md5(part[2 * s + 1 : 2 * (s + {length})]) AS k FROM (SELECT r, c, part, unnest(range(0, n)) AS s FROM chunks)),
    twice AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY k) AS n FROM starts) WHERE n > 1),
    marked AS (SELECT r, s, CAST(coalesce(s > lag(s) OVER (PARTITION BY r ORDER BY s) + {length}, true) AS INT) AS fresh FROM twice),
    spans AS (SELECT r, min(s) AS a, max(s) + {length} AS b FROM (SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS no FROM marked) GROUP BY r, no),
    gaps AS (SELECT r, a, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS kept_from, b FROM spans),
    cut AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(h[2 * kept_from + 1 : 2 * a], '' ORDER BY a) AS kept, max(b) AS rest
      FROM gaps JOIN doc USING (r) GROUP BY r)
    SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
      sha256(unhex(concat(kept, h[2 * coalesce(rest, 0) + 1 :]))) AS kept_sha256 FROM doc LEFT JOIN cut USING (r)"""
