"""Phrases by association: n-grams counted in a shallow trie with bursting hash containers, spilled as sorted runs and merged by prefix."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import save_table, ship_package
from .common import mix64
from .suffixes import binary

WORDS, LEAST, TOP, SHARE = 3, 10, 2_000, 50
#: Bits of a word id in a packed phrase of up to three words.
ID_BITS = 21
#: Entries of a container before it bursts; entries of all containers of a task before subtrees are spilled; words a task numbers.
BURST, HELD, VOCABULARY = 32_768, 1_000_000, 600_000
#: Word occurrences that are sorted and added to the trie at once.
BATCH_WORDS = 500_000
PIECE_BYTES = 1 << 20
#: Bytes of text for each prefix partition.
PARTITION_BYTES = 8_000_000

#: Pieces end at these characters.
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: A to Z lower-cased, breaks to line feeds, tabs to spaces. Capital letters are free to stand for a break afterwards.
FOLD = bytes(10 if c in BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
STOP = b"A"
UNKNOWN = "und"


class Numbers(dict):
    """Ids of words in order of appearance; 1 is a break."""

    def __init__(self):
        super().__init__({STOP: 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def pieces(raw: bytes) -> Iterator[bytes]:
    """Parts of a folded text that end between words."""
    at = 0
    while at < len(raw):
        end = len(raw)
        if end - at > PIECE_BYTES:
            space = raw.find(b" ", at + PIECE_BYTES)
            stop = raw.find(b"\n", at + PIECE_BYTES, space if space >= 0 else end)
            end = min(x for x in (space, stop, end) if x >= 0)
        yield raw[at:end]
        at = end


class Trie:
    """Counts of packed phrases. Leaves are hash containers that cover ranges of first words; a container that grows bursts in two between
    first words, and one that holds a single first word bursts between second words."""

    def __init__(self):
        self.bounds = [0]
        self.leaves: list[dict[int, int]] = [{}]

    def add(self, keys: np.ndarray, counts: np.ndarray) -> int:
        """Adds sorted distinct phrases; returns by how many entries the trie grew."""
        cuts = np.searchsorted(keys, np.array(self.bounds[1:], np.uint64)).tolist()
        keys, counts = keys.tolist(), counts.tolist()
        grown, full = 0, []
        for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(keys)])):
            if a < b:
                leaf = self.leaves[i]
                size, get = len(leaf), leaf.get
                for k, c in zip(keys[a:b], counts[a:b]):
                    leaf[k] = get(k, 0) + c
                grown += len(leaf) - size
                if len(leaf) > BURST:
                    full.append(i)
        for i in reversed(full):
            self.burst(i)
        return grown

    def burst(self, i: int) -> None:
        """Splits a container near its middle, until no part can or need be split."""
        keys = np.array(sorted(self.leaves[i]), np.uint64)
        bounds, todo = [], [(0, len(keys))]
        while todo:
            a, b = todo.pop()
            if b - a > BURST:
                for bits in (2 * ID_BITS, ID_BITS):
                    prefix = keys[a:b] >> np.uint64(bits)
                    edges = np.flatnonzero(prefix[1:] != prefix[:-1]) + 1
                    if len(edges):
                        at = a + int(edges[np.argmin(abs(edges - (b - a) // 2))])
                        bounds.append(int(keys[at] >> np.uint64(bits)) << bits)
                        todo += [(a, at), (at, b)]
                        break
        if bounds:
            whole = self.leaves[i]
            bounds.sort()
            cuts = np.searchsorted(keys, np.array(bounds, np.uint64)).tolist()
            keys = keys.tolist()
            self.leaves[i : i + 1] = [{k: whole[k] for k in keys[a:b]} for a, b in zip([0, *cuts], [*cuts, len(keys)])]
            self.bounds[i + 1 : i + 1] = bounds

    def take(self, wanted: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The entries of some subtrees, which are then empty, in no order."""
        n = sum(len(self.leaves[i]) for i in wanted)
        keys = np.fromiter(chain.from_iterable(self.leaves[i] for i in wanted), np.uint64, n)
        counts = np.fromiter(chain.from_iterable(self.leaves[i].values() for i in wanted), np.int64, n)
        for i in wanted:
            self.leaves[i] = {}
        return keys, counts


def split_ids(keys: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << ID_BITS) - 1)
    return [((keys >> np.uint64(s)) & mask).astype(np.int64) for s in (2 * ID_BITS, ID_BITS, 0)]


class Packer:
    """Runs as bytes: a sorted table of words, then a column for each place of the phrases and one of counts, compressed."""

    def __init__(self):
        self.zip, self.unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

    def pack(self, words: list[bytes], columns: list[np.ndarray], counts: np.ndarray) -> bytes:
        # differences of the sorted first column are small; the other columns keep their values
        table = b"\n".join(words)
        body = b"".join([np.diff(columns[0], prepend=0).astype("<u4").tobytes(), *(c.astype("<u4").tobytes() for c in columns[1:]), counts.astype("<i8").tobytes()])
        head = np.array([len(counts), len(table)], "<i8").tobytes()
        return self.zip.compress(head + table + body)

    def unpack(self, raw: bytes) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
        raw = self.unzip.decompress(raw)
        n, size = np.frombuffer(raw, "<i8", 2).tolist()
        words = raw[16 : 16 + size].split(b"\n")
        cells = [np.frombuffer(raw, "<u4", n, 16 + size + 4 * n * k).astype(np.int64) for k in range(WORDS)]
        cells[0] = np.cumsum(cells[0])
        return words, cells, np.frombuffer(raw, "<i8", n, 16 + size + 4 * n * WORDS)


RUNS = "lang: string, part: int, run: binary"


class Counting:
    """Counts of one task: a trie for each language over common word ids."""

    def __init__(self, partitions: int, words: int):
        self.partitions, self.words, self.packer = partitions, words, Packer()
        self.ids, self.tries, self.entries = Numbers(), {}, 0
        self.forget()
        self.waiting: dict[str, list] = {}
        self.size = 0

    def text(self, lang: str | None, raw: bytes | None) -> Iterator[dict]:
        lang = UNKNOWN if lang is None else lang
        before = []
        for part in pieces((raw or b"").translate(FOLD)):
            found = list(map(self.ids.__getitem__, part.replace(b"\n", b" A ").split()))
            if found:
                self.waiting.setdefault(lang, []).append((len(before), np.array(before + found, np.uint64)))
                self.size += len(found)
                before = (before + found)[1 - self.words :]  # phrases go on where a long text was cut
            if self.size >= BATCH_WORDS or len(self.ids) >= VOCABULARY:
                yield from self.count()
                if len(self.ids) >= VOCABULARY:
                    yield from self.spill(0)
                    before = [self.ids[w] for w in self.renumbered(before)]

    def renumbered(self, ids: list[int]) -> list[bytes]:
        """Starts the numbering anew; returns the words of ``ids``."""
        back = list(self.ids)
        names = [back[i - 1] for i in ids]
        self.ids = Numbers()
        self.forget()
        return names

    def forget(self) -> None:
        """Nothing is sorted yet: words in order, their ids, and their hashes by id."""
        self.sorted, self.at, self.hash_of = np.empty(0, object), np.empty(0, np.int64), np.empty(0, np.uint64)

    def count(self) -> Iterator[dict]:
        stop = np.uint64(1)
        for lang, parts in self.waiting.items():
            fresh = np.concatenate([np.arange(len(x)) >= n for n, x in parts])
            head = np.zeros(len(fresh), bool)
            head[np.cumsum([0, *(len(x) for _, x in parts[:-1])])] = True
            x = np.concatenate([x for _, x in parts])
            part = np.cumsum(head | (x == stop))
            word = x != stop
            keys = [x[word & fresh] << np.uint64(2 * ID_BITS)]
            for k in range(1, self.words):
                whole = (part[k:] == part[:-k]) & word[: len(x) - k] & fresh[k:]
                key = np.zeros(int(whole.sum()), np.uint64)
                for j in range(k + 1):
                    key |= x[j : len(x) - k + j][whole] << np.uint64((2 - j) * ID_BITS)
                keys.append(key)
            keys, counts = np.unique(np.concatenate(keys), return_counts=True)
            self.entries += self.tries.setdefault(lang, Trie()).add(keys, counts)
            if self.entries > HELD:
                yield from self.spill(HELD // 2)
        self.waiting, self.size = {}, 0

    def ordered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words in order, the place of each id in that order (from 1), and a hash of each place. New words are sorted and put where they belong among the others."""
        known = len(self.sorted)
        new = list(islice(self.ids, known, None))
        if new:
            hashes = np.fromiter(((zlib.crc32(w) << 32) | zlib.adler32(w) for w in new), np.uint64, len(new))
            self.hash_of = np.concatenate((self.hash_of, hashes))
            order = sorted(range(len(new)), key=new.__getitem__)
            words = np.empty(len(new), object)
            words[:] = [new[i] for i in order]
            old, low, gaps = self.sorted.tolist(), 0, []
            for w in words.tolist():
                low = bisect_left(old, w, low)
                gaps.append(low)
            self.sorted = np.insert(self.sorted, gaps, words)
            self.at = np.insert(self.at, gaps, np.array(order, np.int64) + known + 1)
        rank = np.zeros(len(self.at) + 1, np.int64)
        rank[self.at] = np.arange(1, len(self.at) + 1)
        hashed = np.zeros(len(self.at) + 1, np.uint64)
        hashed[1:] = mix64(self.hash_of[self.at - 1])
        return self.sorted, rank, hashed

    def spill(self, keep: int) -> Iterator[dict]:
        """Hands on whole subtrees, the largest first, until at most ``keep`` entries are left."""
        leaves = sorted(((len(leaf), lang, i) for lang, t in self.tries.items() for i, leaf in enumerate(t.leaves) if leaf), reverse=True)
        chosen: dict[str, list[int]] = {}
        for size, lang, i in leaves:
            if self.entries <= keep:
                break
            chosen.setdefault(lang, []).append(i)
            self.entries -= size
        if not chosen:
            return
        words, rank, hashed = self.ordered()
        for lang, wanted in chosen.items():
            keys, counts = self.tries[lang].take(wanted)
            a, b, c = (rank[i] for i in split_ids(keys))
            order = np.argsort((a << (2 * ID_BITS)) | (b << ID_BITS) | c)
            a, b, c, counts = a[order], b[order], c[order], counts[order]
            salt = np.uint64(zlib.crc32(lang.encode("utf-8", "surrogatepass")))
            part = (mix64(hashed[a] * np.uint64(3) + hashed[b] + salt) % np.uint64(self.partitions)).astype(np.int64)
            order = np.argsort(part.astype(np.uint16) if self.partitions <= 1 << 16 else part, kind="stable")
            a, b, c, part, counts = a[order], b[order], c[order], part[order], counts[order]
            out = {"lang": [], "part": [], "run": []}
            for at in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
                used, number = np.unique(np.concatenate((a[at], b[at], c[at], [0])), return_inverse=True)
                cells = [number[k * len(at) : (k + 1) * len(at)] for k in range(WORDS)]
                out["lang"].append(lang)
                out["part"].append(int(part[at[0]]))
                out["run"].append(self.packer.pack(words[used[1:] - 1].tolist(), cells, counts[at]))
            yield out


def counted_runs(docs: DataFrame, partitions: int, words: int) -> DataFrame:
    """Spilled runs of all tasks, by language and prefix partition."""
    types = StructType.fromDDL(RUNS)
    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Counting(partitions, words)

        def sent(rows):
            for r in rows:
                yield pa.RecordBatch.from_arrays([pa.array(r[f.name], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), binary(batch, "text")):
                yield from sent(work.text(lang, raw))
        yield from sent(work.count())
        yield from sent(work.spill(0))

    ship_package(docs.sparkSession)
    return docs.select("lang", "text").mapInArrow(run, types)


def merge_runs(table: pa.Table, least: int) -> pa.Table:
    """Counts of a prefix partition of a language: phrases counted ``least`` times or more, and a row (no phrase) with the number of its words."""
    packer, numbers = Packer(), {}
    runs = [packer.unpack(r) for r in table.column("run").to_pylist()]
    for words, _, _ in runs:
        numbers.update(dict.fromkeys(words))
    names = sorted(numbers)
    numbers = {w: i + 1 for i, w in enumerate(names)}
    size = len(names) + 1
    keys: list[list[np.ndarray]] = [[] for _ in range(WORDS)]
    for words, cells, _ in runs:
        to = np.array([0, *(numbers[w] for w in words)], np.int64)  # rising, so a run stays sorted
        for k in range(WORDS):
            keys[k].append(to[cells[k]])
    a, b, c = (np.concatenate(k) for k in keys)
    counts = np.concatenate([r[2] for r in runs])
    front = a * size + b
    if size < 1 << ID_BITS:
        key = front * size + c
    else:
        key = np.unique(front, return_inverse=True)[1] * size + c
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
    f, at = np.add.reduceat(counts[order], first), order[first]
    total = int(f[b[at] == 0].sum())
    at, f = at[f >= least], f[f >= least]
    phrases = [b" ".join(names[i - 1] for i in (x, y, z) if i) for x, y, z in zip(a[at].tolist(), b[at].tolist(), c[at].tolist())]
    k = 1 + (b[at] > 0) + (c[at] > 0)
    lang = table.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * (len(at) + 1), pa.string()), "phrase": pa.array([*phrases, None], pa.binary()).cast(pa.string()), "k": pa.array([*k.tolist(), 0], pa.int32()), "f": pa.array([*f.tolist(), total], pa.int64())})


def phrase_counts(docs: DataFrame, words: int = WORDS, least: int = LEAST, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """``lang``, ``phrase``, ``k`` (words), ``f`` of all phrases counted ``least`` times or more; rows with ``k`` = 0 sum up to the words of a language."""
    if not 2 <= words <= WORDS:
        raise ValueError("phrases have two or three words")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // partition_bytes))
    runs = counted_runs(docs, partitions, words)
    return runs.groupBy("lang", "part").applyInArrow(lambda t: merge_runs(t, least), "lang string, phrase string, k int, f bigint")


def collocations(docs: DataFrame, words: int = WORDS, least: int = LEAST, top: int = TOP, share: int = SHARE, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The ``top`` phrases of two to ``words`` words of each language by their weakest cut.

    Reads ``text`` and ``lang``; other columns are ignored. Each task counts in tries over word ids: hash containers below first words, which
    burst between words as they grow. When the containers hold HELD entries, whole subtrees are spilled as sorted runs, cut by prefix partition (language and first two words),
    and each partition merges its runs. Only what was counted ``least`` times leaves a partition, which is all that scores need, as
    a part of a phrase is at least as frequent as the phrase. A frequent word, or pair of words, is one entry for each run, so no partition is hot.
    Scores are exact (38-digit decimals). A phrase inside a longer candidate with ``share`` % of its count is dropped.

    Null and empty texts have no words, a null language is ``und``, a very long text is counted in pieces that carry its last words over.
    Repeated rows count again. Ties of score go by count, then by phrase in byte order; ties of cuts to the first. An empty table gives none.
    """
    counts = save_table(phrase_counts(docs, words, least, partition_bytes), "phrases")
    n = counts.where("k = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    counts = counts.where("k > 0").select("lang", "phrase", "k", "f")
    many = counts.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"))
    split = many.withColumn("w", F.split("phrase", " ")).select(
        "lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "w"
    ).withColumns({"left": F.array_join(F.expr("slice(w, 1, cut)"), " "), "right": F.array_join(F.expr("slice(w, cut + 1, k - cut)"), " ")}).drop("w")
    l, r = (counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)) for side, name in (("left", "l"), ("right", "r")))
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = split.join(l, ["lang", "left"]).join(r, ["lang", "right"])
    cuts = cuts.withColumn("num", wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("den", wide("l") * wide("r")).withColumn("score", F.expr("num div den"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    inner = many.withColumn("w", F.split("phrase", " ")).select("lang", "a", F.explode(F.expr(
        "flatten(transform(sequence(2, greatest(k - 1, 2)), m -> if(k > m, transform(sequence(1, k - m + 1), i -> array_join(slice(w, i, m), ' ')), array())))"
    )).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("inside") < share * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.col("b.score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))


def oracle() -> str:
    """The same for DuckDB, occurrence by occurrence."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH piece AS (
  SELECT lang, row_number() OVER () AS id, piece FROM (
    SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(text, '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL)),
list AS (SELECT lang, id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
word AS (SELECT lang, id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM list),
run AS (SELECT lang, w AS w1, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM word WINDOW p AS (PARTITION BY id ORDER BY i)),
f AS (
  SELECT lang, w1 AS phrase, 1 AS k, count(*) AS f FROM run GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2, 2, count(*) FROM run WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) FROM run WHERE w3 IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {LEAST}),
cut AS (
  SELECT lang, phrase, k, a, 1 AS cut, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM c
  UNION ALL SELECT lang, phrase, k, a, 2, array_to_string(w[1:2], ' '), w[3] FROM c WHERE k = 3),
scored AS (
  SELECT cut.lang, cut.phrase, cut.a, cut, x.f AS l, y.f AS r,
    CAST((1000000::HUGEINT * cut.a * cut.a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.x JOIN f y ON y.lang = cut.lang AND y.phrase = cut.y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (
  SELECT lang, phrase, max(a) AS inside FROM (
    SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM c WHERE k = 3
    UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE k = 3) GROUP BY 1, 2),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.inside IS NULL OR 100 * i.inside < {SHARE} * b.a)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, n.n, k.score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) k
JOIN n ON n.lang = k.lang WHERE k.rank <= {TOP}
"""
