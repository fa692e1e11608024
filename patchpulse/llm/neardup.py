"""Near-duplicates: weighted minimum hashing with exponential arrivals, banding, verification and classes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import classes, mix64, scan, texts_of
from .sharding import saved
from .substrings import OF_PLACE, pack, raw_of, runs, unpack, word_hashes

SHINGLE_WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
#: Elements whose arrivals are simulated together, and texts compared in one block.
TOGETHER, CHUNK = 200_000, 256
#: Rows of bucket members in a file, and so in a task that writes one.
ROWS_PER_FILE = 100_000
#: Bytes of a shingle's hash that are kept for the verification.
KEY_BYTES = 5
GOLD, STEP_1, STEP_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95), np.uint64(0xA0761D6478BD642F)


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of runs of five words with their counts; a shorter text with words is one shingle."""
    words = word_hashes(raw_of(text))
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(runs(words, min(SHINGLE_WORDS, len(words)), OF_PLACE), return_counts=True)


def weight(counts: np.ndarray) -> np.ndarray:
    """Repeats count, but little: a text is not its most repeated line."""
    return 1 + np.log(counts) / 4


def signatures(owner: np.ndarray, keys: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` texts and each register the key that arrives there first; 0 for a text without keys.

    Every key is a Poisson process of the rate of its weight, whose arrivals fall on registers at random; times and registers are
    functions of the key, so texts with a key in common see the same arrivals. A key stops once its next arrival is later than
    the latest register of its text. Two texts agree in a register with the probability Jaccard similarity of their weights.
    """
    time = np.full(n * REGISTERS, np.inf)
    first = np.zeros(n * REGISTERS, np.uint64)
    at, now, step = np.arange(len(keys)), np.zeros(len(keys)), np.uint64(0)
    with np.errstate(over="ignore"):
        while len(at):
            step += np.uint64(1)
            k = keys[at]
            uniform = ((mix64(k + step * STEP_1) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
            now = now - np.log(uniform) / weights[at]
            slot = owner[at] * REGISTERS + (mix64((k ^ GOLD) + step * STEP_2) % np.uint64(REGISTERS)).astype(np.int64)
            np.minimum.at(time, slot, now)
            won = time[slot] == now
            first[slot[won]] = k[won]
            latest = time.reshape(n, REGISTERS).max(1)
            going = now < latest[owner[at]]
            at, now = at[going], now[going]
    return first.reshape(n, REGISTERS)


def band_keys(first: np.ndarray) -> np.ndarray:
    """A 64-bit value of each band of registers, different from band to band."""
    parts = first.reshape(len(first), BANDS, ROWS)
    with np.errstate(over="ignore"):
        mixed = (parts * np.array(OF_PLACE[:ROWS], np.uint64)).sum(2, dtype=np.uint64) + (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * GOLD
    return mix64(mixed).view(np.int64)


SIGNED = "doc_id: bigint, key: string, n: int, bands: array<bigint>"


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` (equal for equal texts), number of distinct shingles and band values of every document."""

    def start():
        def work(batch):
            ids, keys, texts = batch.column(0), batch.column(1), batch.column(2)
            at, n = 0, batch.num_rows
            while at < n:
                begin, held, sets = at, 0, []
                while at < n and (held < TOGETHER or at == begin):
                    sets.append(shingles(texts[at].as_py()))
                    held += len(sets[-1][0])
                    at += 1
                sizes = [len(s) for s, _ in sets]
                owner = np.repeat(np.arange(len(sets)), sizes)
                first = signatures(owner, np.concatenate([s for s, _ in sets]), weight(np.concatenate([c for _, c in sets])), len(sets))
                bands = band_keys(first)
                yield {"doc_id": ids.slice(begin, at - begin), "key": keys.slice(begin, at - begin), "n": sizes, "bands": [b if s else [] for b, s in zip(bands, sizes)]}

        return work

    return scan(docs, ["doc_id", "key", "text"], SIGNED, start)


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key``, ``shingles`` (packed and sorted) of the wanted texts (``key``, ``doc_id``)."""
    w = wanted.select(F.col("key").alias("k"), F.col("doc_id").alias("i"))
    some = docs.join(w, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("i")), "left_semi")

    def start():
        def work(batch):
            mask = np.uint64((1 << 8 * KEY_BYTES) - 1)
            yield {"key": batch.column(0), "shingles": [pack(np.unique(shingles(t)[0] & mask), KEY_BYTES) for t in texts_of(batch)]}

        return work

    return scan(some, ["key", "text"], "key: string, shingles: binary", start).groupBy("key").agg(F.any_value("shingles").alias("shingles"))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= least * (len(a) + len(b) - common) - 1e-9


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets reach the similarity."""
    with_a = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a")
    both = with_a.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")

    def start():
        def work(batch):
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            at = [i for i in range(len(a)) if similar(unpack(x[i], KEY_BYTES), unpack(y[i], KEY_BYTES), least)]
            yield {"a": [a[i] for i in at], "b": [b[i] for i in at]}

        return work

    return scan(both, ["a", "b", "x", "y"], "a: string, b: string", start)


def block_links(rows: DataFrame, least: float) -> DataFrame:
    """For each block links between its left and right texts, one for each two labels; at most two chunks of texts meet in one."""

    def compare(table: pa.Table) -> pa.Table:
        keys, labels, is_left = (np.array(table.column(c).to_pylist(), object) for c in ("key", "label", "is_left"))
        sets = [unpack(s, KEY_BYTES) for s in table.column("shingles").to_pylist()]
        left, right = np.flatnonzero(is_left == True), np.flatnonzero(is_left == False)  # noqa: E712
        found: list[tuple[str, str]] = []
        if len(left) and len(right):
            sizes = np.array([len(s) for s in sets])
            flat = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), sizes)
            values, column, times = np.unique(flat, return_inverse=True, return_counts=True)
            common = np.zeros((len(left), len(right)), np.int64)
            row_of = np.full(len(sets), -1)
            row_of[left], at_right = np.arange(len(left)), np.full(len(sets), -1)
            at_right[right] = np.arange(len(right))
            shared = times[column] > 1  # a shingle of one text alone adds to no overlap
            owner, column = owner[shared], column[shared]
            _, column = np.unique(column, return_inverse=True)
            width = 8192
            for low in range(0, int(column.max()) + 1 if len(column) else 0, width):
                some = (column >= low) & (column < low + width)
                dense = np.zeros((len(sets), width), np.float32)
                dense[owner[some], column[some] - low] = 1
                common += (dense[left] @ dense[right].T).astype(np.int64)
            union = sizes[left][:, None] + sizes[right][None, :] - common
            i, j = np.nonzero(common >= least * union - 1e-9)
            first: dict[tuple[str, str], tuple[str, str]] = {}  # one link joins two classes
            for p, q in zip(left[i], right[j]):
                if labels[p] != labels[q]:
                    first.setdefault((labels[p], labels[q]), (keys[p], keys[q]))
            found = list(first.values())
        return pa.table({"a": pa.array([x for x, _ in found], pa.string()), "b": pa.array([y for _, y in found], pa.string())})

    return rows.groupBy("pair").applyInArrow(compare, "a string, b string")


BLOCK = ("pair", "key", "label", "is_left")


def small_blocks(rows: DataFrame) -> DataFrame:
    """A block for each bucket of at most one chunk: the texts outside its largest class on the left, all on the right."""
    here = rows.withColumn("pair", F.col("bv").cast("string"))
    left = here.where("minor").withColumn("is_left", F.lit(True))
    return left.select(*BLOCK).union(here.withColumn("is_left", F.lit(False)).select(*BLOCK))


def large_blocks(spark: SparkSession, rows: DataFrame, files: int) -> DataFrame:
    """Blocks of two chunks for the large buckets.

    The buckets of several bands that share texts form one zone, so a group of near copies is cut into chunks once and not once
    for each band. A chunk's texts outside the largest class of a bucket meet every chunk of the zone.
    """
    edges = rows.where("key <> leader").select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()
    zones = saved(classes(spark, edges), "zones", files)
    parts = zones.groupBy("label").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts")).withColumnRenamed("label", "zone")
    place = zones.select(F.col("node").alias("key"), F.col("label").alias("zone")).join(parts, "zone")
    place = place.withColumn("no", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    nodes = saved(rows.groupBy("key", "label").agg(F.max("minor").alias("minor")).join(place, "key"), "zone-nodes", files)
    open_chunks = nodes.where("minor").select("zone", F.col("no").alias("left_no")).distinct()

    def pair(left: str, right: str):
        return F.concat_ws("/", "zone", F.col(left).cast("string"), F.col(right).cast("string")).alias("pair")

    left = nodes.where("minor").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = left.select(pair("no", "other"), "key", "label", F.lit(True).alias("is_left"))
    right = nodes.join(open_chunks, "zone").select(pair("left_no", "no"), "key", "label", F.lit(False).alias("is_left"))
    return left.union(right)


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row for each document: its text's key, its class, the class's size and whether it represents the class.

    Reads ``doc_id`` and ``text``; other columns are ignored. Texts are sets of shingles of five words (runs without ASCII white space), weighted
    by a damped count. Equal texts are folded first. Signatures give band values; texts of equal band value are candidates.
    Each candidate is compared with one leader of its bucket, the leaders differing from band to band. Buckets whose texts then still belong to
    several classes are compared in blocks of bounded size: every text outside the bucket's largest class with every text of the
    bucket, links only coming out. A link needs a Jaccard similarity of the distinct shingles of at least ``least``; classes are
    the connected groups of links. ``class_id`` is the least id in the class, the document that represents it.

    Null texts count as empty. Empty texts are equal to each other and similar to nothing else; a text of fewer than five words
    is one shingle. Null ids are smaller than none: a class of them alone has a null class id. Repeated rows
    belong to one class; an empty table gives none.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("key"), "text")
    all_rows = saved(signed(docs), "signed")
    texts = saved(all_rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")), "texts")
    postings = texts.select("key", "doc_id", "n", F.explode(F.array_distinct("bands")).alias("bv"))
    leader = F.min(F.struct(F.xxhash64("key", "bv").alias("o"), "key", "n"))
    buckets = postings.groupBy("bv").agg(F.count("*").alias("size"), leader.alias("l")).where("size > 1")
    post = saved(postings.join(buckets, "bv").select("bv", "size", "key", "doc_id", "n", F.col("l.key").alias("leader"), F.col("l.n").alias("leader_n")), "postings")
    files = 1 + post.count() // ROWS_PER_FILE
    sets = saved(shingle_sets(docs, post.select("key", "doc_id").distinct()), "shingles")

    fits = F.least("n", "leader_n") >= least * F.greatest("n", "leader_n") - 1e-9
    star = post.where((F.col("key") != F.col("leader")) & fits).select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()
    links = saved(verified(star, sets, least), "links")
    labels = saved(classes(spark, links), "labels", files)

    labelled = post.where("size > 2").join(labels.withColumnRenamed("node", "key"), "key", "left")
    labelled = saved(labelled.select("bv", "size", "key", "leader", F.coalesce("label", "key").alias("label")), "labelled", files)
    sizes = labelled.groupBy("bv", "label").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("bv").agg(F.max_by("label", F.struct("c", "label")).alias("big"), F.count("*").alias("k")).where("k > 1")
    open_rows = saved(labelled.join(mixed, "bv").withColumn("minor", F.col("label") != F.col("big")), "mixed", files)
    blocks = small_blocks(open_rows.where(F.col("size") <= CHUNK))
    if not open_rows.where(F.col("size") > CHUNK).isEmpty():
        blocks = blocks.union(large_blocks(spark, open_rows.where(F.col("size") > CHUNK), files))
    more = saved(block_links(blocks.join(sets, "key"), least), "more-links")
    if more.isEmpty():
        final = labels
    else:  # what the first links joined stays joined: its star is added to the new links
        final = classes(spark, more.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))

    named = texts.select("key", "doc_id", "copies").join(final.withColumnRenamed("node", "key"), "key", "left")
    named = saved(named.select("key", "doc_id", "copies", F.coalesce("label", "key").alias("class_key")), "named")
    groups = named.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("m"), F.sum("copies").alias("class_size"))
    of_key = named.join(groups, "class_key").select("key", F.col("m.doc_id").alias("class_id"), F.col("m.key").alias("chosen"), "class_size")
    return all_rows.select("doc_id", "key").join(of_key, "key").select(
        "doc_id", "key", "class_id", "class_size", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("chosen"))).alias("representative")
    )


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The representatives' rows with all their columns; of repeated rows of a representative one."""
    keep = near_duplicates(docs, least).where("representative").select(F.col("doc_id").alias("__i"), F.col("key").alias("__k")).distinct()
    keyed = docs.withColumn("__key", F.md5(F.coalesce("text", F.lit(""))))
    kept = keyed.join(keep, (F.col("__key") == F.col("__k")) & keyed["doc_id"].eqNullSafe(F.col("__i")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__key"]).select(*docs.columns)
