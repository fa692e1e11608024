"""Exact links between sparse unit vectors whose cosine reaches a threshold, with work near to the number of postings.

Entries of a vector are ordered (0 = rarest word). Walk along the words that a pair shares, first to last: every entry of one vector
that the walk passes over adds nothing to the cosine, so by Cauchy-Schwarz the squares passed over may sum to 1 - threshold^2 at most
(the residual bound). This gives an inverted index of lists, refined only where it is needed:

1. At first a block is one list.
2. A list of more than ``LIST_NODES`` vectors is split by the next word that its vectors may share (or by there being none), as often as this makes
   less work and as long as a block's vectors stand in ``COPIES`` lists of a level or fewer on average. Every linked pair meets in the list of the words it really
   shares, so nothing is lost. Where the bound leaves most words open, as in prose over frequent words, a block stays one list.
3. A list made by splitting of up to ``LIST_NODES`` vectors is compared as it is: partial cosines are accumulated over blocks of words, and a vector is
   left out as soon as the norm that remains cannot lift any of its pairs to the threshold.
4. Blocks that are not split, and lists that it does not pay to split further, are compared in chunks of bounded size, each two chunks of a list once. Lists
   of up to ``CHUNK`` times ``LIST_NODES`` vectors are one chunk and are sent once; k chunks are sent k times. A chunk is a sparse matrix to its task, made dense at
   once in single precision, and what lies near the threshold is computed again in double precision. Where only components are asked for, some rows are compared with
   all first, so a crowd is one component early and its tiles do not meet each other.

Vectors of one label count as linked already. No pairs are written but links, and no block is collected into one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, save_table

EPS = 1e-9
LIST_NODES = 2048
WHOLE = 1  # a list of up to this many times LIST_NODES that does not pay to split is compared as it is
CHUNK = 32  # a chunk has up to about this many times LIST_NODES vectors: each is sent once for each chunk of its list
COPIES = 10  # lists of a level in which a vector of a block stands, on average, at most
TILE = 1024  # rows of a chunk that are multiplied at once
FIRST = 256  # rows of a chunk that are compared with all others before the rest
NEAR = 1e-4  # cosines in single precision this near the threshold are computed again
DEPTH = 7
STEP = 64  # words accumulated between two looks at the residual bound
LINKS = "a string, b string"


def dense(ords: pd.Series, us: pd.Series, width: int) -> np.ndarray:
    """The sparse rows as a matrix."""
    out = np.zeros((len(ords), width))
    at = np.repeat(np.arange(len(ords)), [len(o) for o in ords])
    out[at, np.concatenate(list(ords))] = np.concatenate(list(us))
    return out


def linked_pairs(matrix: np.ndarray, labels: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i < j) of pairs of different labels whose cosine reaches the threshold; rows have length 1."""
    rows = np.arange(len(matrix))
    partial, left = np.zeros((len(rows), len(rows))), np.ones(len(rows))
    for start in range(0, matrix.shape[1], STEP):
        part = matrix[rows, start : start + STEP]
        partial += part @ part.T
        left = np.maximum(left - (part * part).sum(axis=1), 0)
        rest = np.sqrt(left)
        open_ = (partial + np.outer(rest, rest) >= threshold - 2 * EPS) & (labels[:, None] != labels[None, :])
        keep = open_.any(axis=1)
        if not keep.all():
            rows, labels, left, partial = rows[keep], labels[keep], left[keep], partial[np.ix_(keep, keep)]
        if len(rows) < 2:
            return rows[:0], rows[:0]
    i, j = np.nonzero(np.triu((partial >= threshold - EPS) & (labels[:, None] != labels[None, :]), 1))
    return rows[i], rows[j]


class Forest:
    """Which of the links given so far join what was not joined yet; ``n`` vertices."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def joining(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Positions of links (i, j) that join all that these links join, at most n - 1 of them over all calls."""
        at, chosen = np.arange(len(i)), []
        while True:
            a, b = self.root[i[at]], self.root[j[at]]
            apart = a != b
            at, a, b = at[apart], a[apart], b[apart]
            if not len(at):
                return np.concatenate(chosen) if chosen else at
            high, low = np.maximum(a, b), np.minimum(a, b)
            pick = np.full(len(self.root), -1)
            pick[high[::-1]] = np.arange(len(at))[::-1]  # each root hangs itself on the first lower root given: a crowd makes a star, not a chain
            pick = pick[pick >= 0]
            self.root[high[pick]] = low[pick]
            chosen.append(at[pick])
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def _next_shared(limit: float):
    """Positions the next shared word may have, the length of the vector standing for no further one."""
    pos, size = F.col("pos"), F.size("ord")
    passed = lambda j: F.col("skipped") + F.get("cum", j) - F.get("cum", pos + 1) <= F.lit(limit)
    return F.when(pos < size, F.filter(F.sequence(pos + 1, size), passed)).otherwise(F.array().cast("array<int>"))


def candidate_lists(nodes: DataFrame, block: list[str], threshold: float) -> tuple[list[DataFrame], list[DataFrame]]:
    """(lists short enough to compare, lists for chunks), each of key, node, label; ``nodes`` has block, node, label, ord, u.

    The first of either are whole blocks and have ord and u too: vectors are joined to lists only where a block was split. Lists for chunks have their size as n.
    """
    limit = 1 - threshold * threshold + EPS
    cum = F.expr("aggregate(u, array(0D), (s, x) -> array_append(s, element_at(s, -1) + x * x))")
    whole = nodes.select(F.to_json(F.struct(*block)).alias("key"), "node", "label", "ord", "u")
    sides = nodes.select("node", "ord", cum.alias("cum"))
    level = whole.select("*", F.col("key").alias("root"), F.lit(-1).alias("pos"), F.lit(0.0).alias("skipped"))
    short, flat, blocks = [], [], None
    for depth in range(DEPTH):
        rows, names = (level, ["key", "node", "label"]) if depth else (whole, whole.columns)
        sizes = level.groupBy("key").agg(F.first("root").alias("root"), F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        sizes = save_table(sizes.where("lo <> hi").select("key", "root", "n"), "sizes")
        blocks = sizes.select("root", F.col("n").alias("_block")) if blocks is None else blocks
        short.append(rows.join(broadcast_if_small(sizes.where(F.col("n") <= LIST_NODES).select("key")), "key", "left_semi").select(*names))
        long_ = sizes.where(F.col("n") > LIST_NODES)
        if long_.isEmpty():
            break
        wide = level.join(broadcast_if_small(long_.select("key", "n")), "key")
        wide = (wide.join(sides, "node") if depth else wide.withColumn("cum", cum)).withColumn("next", _next_shared(limit))
        wide = save_table(wide, "long-lists") if depth else wide  # whole blocks are read again where they lie
        cost = wide.groupBy("key", "root", "n").agg(F.sum(F.size("next")).alias("fan"))
        less = (F.col("fan") > 0) & (F.col("fan") * LIST_NODES < F.col("n") * F.col("n")) & F.lit(depth < DEPTH - 1)
        cost = save_table(cost.select("key", "root", "n", "fan", less.alias("less")), "costs")
        room = cost.where("less").groupBy("root").agg(F.sum("fan").alias("_rows")).join(blocks, "root").where(F.col("_rows") <= COPIES * F.col("_block"))
        pays = cost.where("less").join(room.select("root"), "root", "left_semi").select("key", F.lit(True).alias("pays"))
        cost = save_table(cost.join(pays, "key", "left").select("key", "n", F.coalesce("pays", F.lit(False)).alias("pays"),
                                                                (F.col("n") <= WHOLE * LIST_NODES).alias("whole")), "splits")
        short.append(rows.join(broadcast_if_small(cost.where("NOT pays AND whole").select("key")), "key", "left_semi").select(*names))
        flat.append(rows.select(*names).join(broadcast_if_small(cost.where("NOT pays AND NOT whole").select("key", "n")), "key"))
        split = cost.where("pays").select("key")
        if split.isEmpty():
            break
        child = wide.join(broadcast_if_small(split), "key", "left_semi").withColumn("j", F.explode("next"))
        level = save_table(child.select(
            F.concat_ws("~", "key", F.coalesce(F.get("ord", F.col("j")), F.lit(-1)).cast("string")).alias("key"), "node", "label", "root",
            F.col("j").alias("pos"), (F.col("skipped") + F.get("cum", F.col("j")) - F.get("cum", F.col("pos") + 1)).alias("skipped")), "lists")
    return short, flat


def _short_links(lists: DataFrame, sides: DataFrame, threshold: float, width: int, forest: bool) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        labels = pd.factorize(pdf["label"])[0]
        i, j = linked_pairs(dense(pdf["ord"], pdf["u"], width), labels, threshold)
        if forest:
            few = Forest(len(labels)).joining(labels[i], labels[j])
            i, j = i[few], j[few]
        names = pdf["node"].to_numpy()
        return pd.DataFrame({"a": names[i], "b": names[j]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the list that may go on in the next batch
        for pdf in batches:
            if pdf.empty:
                continue
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            going_on = pdf["key"] == pdf["key"].iloc[-1]
            held = pdf[going_on]
            done = [one(g) for _, g in pdf[~going_on].groupby("key", sort=False)]
            if done:
                yield pd.concat(done, ignore_index=True)
        if held is not None:
            yield one(held)

    rows = lists.join(sides.select("node", "ord", "u"), "node").repartition("key").sortWithinPartitions("key")
    return rows.select("key", "node", "label", "ord", "u").mapInPandas(compare, schema=LINKS)


class Rows:
    """Sparse rows of one list in an Arrow table (node, label, ord, u)."""

    def __init__(self, table: pa.Table):
        ords, us = table["ord"].combine_chunks(), table["u"].combine_chunks()
        self.ord, self.u = ords.flatten().to_numpy(), us.flatten().to_numpy()
        self.start = np.concatenate([[0], np.cumsum(ords.value_lengths().to_numpy())])

    def matrix(self, some: np.ndarray, width: int, kind: type) -> np.ndarray:
        """The rows ``some`` made dense."""
        lengths = self.start[some + 1] - self.start[some]
        at = np.repeat(self.start[some] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        out = np.zeros((len(some), width), kind)
        out[np.repeat(np.arange(len(some)), lengths), self.ord[at]] = self.u[at]
        return out


def _sure(rows: Rows, i: np.ndarray, j: np.ndarray, cosine: np.ndarray, threshold: float, width: int) -> np.ndarray:
    """Which of the pairs (i, j) reach the threshold: those near to it are computed again in double precision."""
    sure = cosine >= threshold + NEAR
    for at in np.array_split(np.flatnonzero(~sure), max(1, -(-int((~sure).sum()) // TILE))):
        exact = np.einsum("ij,ij->i", rows.matrix(i[at], width, float), rows.matrix(j[at], width, float))
        sure[at] = exact >= threshold - EPS
    return sure


def chunk_pairs(rows: Rows, labels: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, width: int,
                forest: Forest | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different labels whose cosine reaches the threshold, of rows ``left`` and ``right`` (the same rows, or none in common).

    With ``forest`` (of the labels) only pairs that join what was not joined; a pair may then be of two rows of one side.
    """
    same = left is right
    data = rows.matrix(np.arange(len(labels)), width, np.float32)

    def found(x: np.ndarray, y: np.ndarray, upper: bool):
        cosine = data[x] @ data[y].T
        close = cosine >= threshold - NEAR
        a, b = (labels[x], labels[y]) if forest is None else (forest.root[labels[x]], forest.root[labels[y]])
        close &= a[:, None] != b[None, :]
        i, j = np.nonzero(np.triu(close, 1) if upper else close)
        cosine = cosine[i, j]
        i, j = x[i], y[j]
        sure = _sure(rows, i, j, cosine, threshold, width)
        i, j = i[sure], j[sure]
        if forest is not None and len(i):
            keep = forest.joining(labels[i], labels[j])
            i, j = i[keep], j[keep]
        return i, j

    if forest is not None:
        both = left if same else np.concatenate([left, right])
        some = both[:: max(1, len(both) // FIRST)][:FIRST]
        for start in range(0, len(both), TILE):
            yield found(some, both[start : start + TILE], False)
        # Rows of the largest component so far lie together, and their tiles need not meet.
        largest = np.bincount(forest.root[labels[both]]).argmax()
        sort = lambda side: side[np.argsort(forest.root[labels[side]] != largest, kind="stable")]
        left, right = (sort(left),) * 2 if same else (sort(left), sort(right))
    for s in range(0, len(left), TILE):
        x = left[s : s + TILE]
        for t in range(s if same else 0, len(right), TILE):
            y = right[t : t + TILE]
            if forest is not None:
                a, b = forest.root[labels[x]], forest.root[labels[y]]
                if (a == a[0]).all() and (b == a[0]).all():
                    continue
            yield found(x, y, same and s == t)


def chunked(lists: DataFrame) -> DataFrame:
    """Lists (key, n, node, label, ord, u) as pairs of chunks, (ca, cb) with ca <= cb: a vector for each chunk of its list."""
    chunks = F.ceil(F.col("n") / (CHUNK * LIST_NODES)).cast("int")
    own = lists.withColumn("_k", chunks).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("_k")).cast("int"))
    return own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).select(
        "key", F.least("chunk", "_other").alias("ca"), F.greatest("chunk", "_other").alias("cb"), "chunk", "node", "label", "ord", "u")


def _chunk_links(lists: DataFrame, threshold: float, width: int, forest: bool, stars: bool) -> DataFrame:
    """Links of lists (key, n, node, label, ord, u) in chunks."""
    def links(table: pa.Table) -> pa.Table:
        names = table["node"].to_numpy()
        labels = table["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        rows, chunk = Rows(table), table["chunk"].to_numpy()
        left = np.flatnonzero(chunk == table["ca"][0].as_py())
        right = left if table["ca"][0] == table["cb"][0] else np.flatnonzero(chunk == table["cb"][0].as_py())
        joined = Forest(labels.max() + 1) if forest or stars else None
        found = list(chunk_pairs(rows, labels, left, right, threshold, width, joined)) if len(left) and len(right) else []
        if stars:
            first = np.full(labels.max() + 1, len(names))
            np.minimum.at(first, labels, np.arange(len(names)))  # a row of each label
            j = np.flatnonzero(joined.root != np.arange(len(first)))
            i, j = first[joined.root[j]], first[j]
        else:
            i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
        return pa.table({"a": pa.array(names[i], pa.string()), "b": pa.array(names[j], pa.string())})

    return chunked(lists).groupBy("key", "ca", "cb").applyInArrow(links, schema=LINKS)


def similarity_links(nodes: DataFrame, block: list[str], threshold: float, width: int, forest: bool = False, stars: bool = False) -> DataFrame:
    """(a, b) of every pair of one block, of different labels, whose cosine reaches the threshold.

    With ``forest`` each comparison gives only links that join labels it has not joined yet: the components are the same, but
    the number of links goes with the vectors compared and not with the square of a crowd. With ``stars`` a comparison in chunks gives, in place of links,
    one vector of each component it found beside every other: components again the same, with short paths.
    ``nodes``: block, node, label, ord (ascending, below ``width``) and u (a unit vector, not empty).
    """
    short, flat = candidate_lists(nodes, block, threshold)
    sides = nodes.select("node", "ord", "u")
    size = lambda lists: lists.withColumn("n", F.lit(1))  # one chunk
    whole = [size(x) for x in short if "u" in x.columns] + [x if "u" in x.columns else x.join(sides, "node") for x in flat]
    out = _chunk_links(reduce(DataFrame.unionByName, whole), threshold, width, forest, stars)
    if split := [x for x in short if "u" not in x.columns]:
        out = out.unionByName(_short_links(reduce(DataFrame.unionByName, split), nodes, threshold, width, forest or stars))
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
