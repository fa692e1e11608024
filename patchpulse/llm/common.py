"""What the operators share: Arrow scans, text rules, class labels of links."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import fresh_path, materialise, ship_package  # noqa: F401

#: Rows of labels whose crc32 of the id leaves this remainder are never learned from.
HELD_OUT_REMAINDER, HELD_OUT_MODULUS = 2, 4
#: Links in a file, and so in a task that writes one.
LINKS_PER_FILE = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for documents whose labels are kept for measuring; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT_MODULUS == HELD_OUT_REMAINDER, F.lit(False))


def scan(df: DataFrame, columns: list[str], schema: str, start: Callable[[], Callable[[pa.RecordBatch], Iterable[dict]]]) -> DataFrame:
    """Rows made in Python workers, Arrow batch by batch.

    ``start`` runs once for each task and returns the function of a batch. That function yields dictionaries of columns
    (lists or arrays), so that a large batch can be answered in parts. Only ``columns`` are read.
    """
    ship_package(df.sparkSession)
    df = df.select(*columns)
    types = StructType.fromDDL(schema)
    names, arrow = types.names, to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            work = work or start()
            for part in work(batch):
                yield pa.RecordBatch.from_arrays([pa.array(part[n], type=arrow.field(n).type) for n in names], schema=arrow)

    return df.mapInArrow(run, types)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int, max_chars: int) -> list[tuple[str, int]]:
    """A bounded sample of learnable labelled texts, brought to the driver.

    At most ``rows_per_class`` documents of each class, those with the least hash of their id, so that the sample does not
    depend on partitions or their order; of these the texts of at most ``max_chars`` characters. Held-out rows are left out. The
    ids are chosen from the labels alone and broadcast, as their number is bounded, so no text is moved but those of the sample.
    """
    lab = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("__label"))
    lab = lab.where(~held_out(F.col("doc_id"))).withColumn("__order", F.xxhash64("doc_id"))
    chosen = None
    for value in (0, 1):
        part = lab.where(F.col("__label") == value).orderBy("__order", "doc_id").limit(rows_per_class)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "__order", "__label").agg(F.min("text").alias("text"))
    return [(r["text"], r["__label"]) for r in sorted(rows.collect(), key=lambda r: (r["__label"], r["__order"], r["doc_id"]))]


def mix64(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value of each 64-bit value (the public splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def classes(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``node``, ``label``: the least node reachable over ``links`` (``a``, ``b``), for every node on a link.

    Alternates between hanging each node's larger neighbours and its smaller ones on its least neighbour, until nothing
    changes. Each pass keeps the number of links or lessens it; a hot node is split by the partial aggregates.
    """
    def save(df: DataFrame, files: int | None = None) -> DataFrame:
        path = fresh_path(spark, "classes")
        (df.coalesce(files) if files else df).write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    edges = save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    files = 1 + edges.count() // LINKS_PER_FILE  # later passes have no more links than this one
    seen = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = save(small.union(low2.select("a", F.col("m").alias("b"))).distinct(), files)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            stars = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
            return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        seen = now
