"""Sharding by a k-d tree: nodes are cut at weighted medians along their widest dimension until one shard is left of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path

#: A dimension has this many bits in an order key; below them come the bits that part rows of equal value.
DIM_BITS, TIE_BITS = 14, 28
#: Bits that one pass over the data settles.
PASS_BITS = 14
#: Equal texts stay together unless they hold more than this share of a shard.
GROUP_SHARE = 0.05
#: Rows that are numbered in one task.
SLOT_ROWS = 20_000


def scaled(c: Column) -> Column:
    """A hash of the value as one of the cells of a dimension; null is a value of its own."""
    return F.pmod(F.xxhash64(c, c.isNull()), F.lit(1 << DIM_BITS))


def ties(c: Column) -> Column:
    return F.pmod(F.xxhash64(c, F.lit("tie")), F.lit(1 << TIE_BITS))


def saved(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Writes ``df`` below the shared folder and reads it back: passes share it, and lost executors do not lose it.

    ``files`` is given where a bound on the rows is known and more files would be small ones.
    """
    path = fresh_path(df.sparkSession, name)
    (df.coalesce(files) if files else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(docs: DataFrame, shards: int) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, coordinates ``x0`` source, ``x1`` language, ``x2`` length, and ``tie``.

    Documents of equal text share all of them, those of the group's least source and language, so no cut parts them. Groups
    too large for that have a tie value for each document.
    """
    text = F.coalesce("text", F.lit(""))
    meta = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), "source", "lang"
    )
    meta = saved(meta, "shard-meta")
    total = meta.agg(F.sum("size")).first()[0] or 0
    groups = meta.groupBy("h", "text_crc32").agg(F.min("source").alias("s"), F.min("lang").alias("l"), F.sum("size").alias("w"), F.count("*").alias("n"))
    # a text that occurs once keeps its own row; only copies are joined
    copies = groups.where("n > 1").select("h", "text_crc32", "s", "l", (F.col("w") > GROUP_SHARE * total / shards).alias("large"))
    joined = meta.join(copies, ["h", "text_crc32"], "left")
    own = F.col("large").isNull()
    return joined.select(
        "doc_id",
        "size",
        "text_crc32",
        scaled(F.when(own, F.col("source")).otherwise(F.col("s"))).alias("x0"),
        scaled(F.when(own, F.col("lang")).otherwise(F.col("l"))).alias("x1"),
        F.least(F.lit((1 << DIM_BITS) - 1), F.floor(F.log2(F.col("size")) / 40 * (1 << DIM_BITS))).cast("long").alias("x2"),
        F.when(F.col("large"), ties(F.col("doc_id"))).otherwise(ties(F.col("h"))).alias("tie"),
    )


def cut(now: DataFrame) -> DataFrame:
    """For each node ``lo``, ``k`` with more than one shard: its widest dimension ``dim`` and the order key ``at`` it is cut at.

    The cut is the weighted median, or for an odd number of shards the matching quantile. Each pass over the rows sums weights by
    the next bits of the order key inside the part that holds the quantile, so a task sees partial sums, never a node's rows.
    """
    dims = ("x0", "x1", "x2")
    extents = [(F.max(x) - F.min(x)) for x in dims]
    nodes = now.where("k > 1").groupBy("lo", "k").agg(F.sum("size").alias("w"), *[e.alias(f"e{i}") for i, e in enumerate(extents)])
    widest = F.expr("CASE WHEN e0 >= e1 AND e0 >= e2 THEN 0 WHEN e1 >= e2 THEN 1 ELSE 2 END")
    state = nodes.select("lo", widest.alias("dim"), (F.col("w") * F.floor(F.col("k") / 2) / F.col("k")).alias("goal"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    bits = DIM_BITS + TIE_BITS
    order = F.expr(f"shiftleft(CASE dim WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END, {TIE_BITS}) + tie")
    left = bits
    while left:
        step = min(PASS_BITS, left)
        rows = now.where("k > 1").join(F.broadcast(state), "lo").withColumn("o", order)  # a row for each node, so at most one for each shard
        rows = rows.where(F.shiftright("o", left) == F.col("prefix")) if left < bits else rows
        left -= step
        sums = rows.groupBy("lo", "dim", "goal", "before", F.shiftright("o", left).alias("b")).agg(F.sum("size").alias("w"))
        over = Window.partitionBy("lo").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upto", F.col("before") + F.sum("w").over(over))
        state = sums.where("upto >= goal").groupBy("lo").agg(F.min(F.struct("b", "dim", "goal", (F.col("upto") - F.col("w")).alias("before"), "w")).alias("m"))
        state = state.select("lo", "m.dim", "m.goal", F.col("m.b").alias("prefix"), "m.before", F.col("m.w").alias("w"))
        if left:
            state = state.drop("w")
    # the cut goes to that side of the last part which is nearer to the quantile
    beyond = (F.col("before") + F.col("w") - F.col("goal")) < (F.col("goal") - F.col("before"))
    return state.select("lo", "dim", (F.col("prefix") + beyond.cast("long")).alias("at"))


def stepped(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Moves each row to its side of its node's cut."""
    rows = rows.join(F.broadcast(cuts), "lo", "left")  # a row for each node, so at most one for each shard
    order = F.expr(f"shiftleft(CASE dim WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END, {TIE_BITS}) + tie")
    half = F.floor(F.col("k") / 2).cast("int")
    right = F.col("at").isNotNull() & (order >= F.col("at"))
    lo = F.when(right, F.col("lo") + half).otherwise(F.col("lo"))
    k = F.when(F.col("at").isNull(), F.col("k")).when(right, F.col("k") - half).otherwise(half)
    return rows.select(*[c for c in rows.columns if c not in ("lo", "k", "dim", "at")], lo.alias("lo"), k.alias("k"))


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Shard and place in it for every document, by a k-d tree over source, language and length.

    Reads ``doc_id``, ``text``, ``source`` and ``lang``; other columns are ignored. A document weighs the UTF-8 bytes of its text plus 8. The tree starts
    with all documents and ``shards`` leaves (or as many as leaves of ``target_bytes`` need); each node is cut along the dimension in which
    its documents spread widest, at the weighted quantile that halves its leaves. Documents of equal text land in one shard unless
    their group exceeds a twentieth of a shard, when it is spread. ``slot`` numbers the documents of a shard from 0 without gaps.

    Only DataFrame functions run. The passes return one row for each node; nothing else leaves the executors.
    Null texts weigh 8; null sources, languages and ids are values like others; ties are parted by hashes of the text; repeated rows get slots of
    their own; an empty table gives none.
    """
    if shards is None:
        total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
        shards = max(1, -(-total // max(1, target_bytes or 1 << 28)))
    root = placed(docs, shards).withColumns({"lo": F.lit(0), "k": F.lit(shards)})
    now = saved(root, "shard-coordinates")  # written with its node, so that the joins below see a column and no constant
    count = now.count()
    largest = shards
    while largest > 1:
        now = stepped(now, saved(cut(now), "shard-cuts"))
        largest -= largest // 2
    parts = max(1, -(-count // (shards * SLOT_ROWS)))
    now = now.select("doc_id", "size", "text_crc32", F.col("lo").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"))
    now = saved(now, "shard-of")
    firsts = now.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    out = now.withColumn("place", place).join(firsts, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("place") + F.col("first")).alias("slot"))
