"""Exact quantiles without collecting a group.

``percentile`` keeps every distinct value of a group in one task. Here equal values are counted first and the counts are laid
out in ranges of about equal numbers of values, whatever their distribution; only the ranges that hold a wanted rank are ordered
value by value. Results equal linear interpolation between the two neighbouring ranks (``quantile_cont``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import save_table


def quantile_name(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


def in_ranges(counts: DataFrame, *order: str) -> DataFrame:
    """Written out with ``bin``: rows of a lower bin come before those of a higher one. Bins follow a sample of the rows, so they
    are of about equal size even if one value lies far from the others."""
    return save_table(counts.repartitionByRange(*order).withColumn("bin", F.spark_partition_id()), "ranges")


def exact_quantiles(df: DataFrame, column: str, probs: tuple[float, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per group with columns p25, p50, ... (NULL values are ignored)."""
    keys = list(keys) or ["_all"]
    src = df if keys != ["_all"] else df.withColumn("_all", F.lit(1))
    src = src.select(*keys, F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    counts = in_ranges(src.groupBy(*keys, "v").agg(F.count("*").alias("c")), *keys, "v")
    totals = counts.groupBy(*keys).agg(F.sum("c").alias("n"))
    # At most a row per group and range from here.
    per_bin = counts.groupBy(*keys, "bin").agg(F.sum("c").alias("bc")).join(totals, keys)
    before = F.coalesce(
        F.sum("bc").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    per_bin = per_bin.withColumn("before", before)
    last = F.col("n") - 1
    ranks = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor(F.lit(p) * last), F.ceil(F.lit(p) * last)) for p in probs
    ])))
    wanted = per_bin.where(
        F.exists(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("bc")))
    ).select(*keys, "bin", "before", "n")
    inside = counts.join(wanted, [*keys, "bin"])
    w = Window.partitionBy(*keys, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.col("before") + F.sum("c").over(w)).withColumn(
        "start", F.col("upto") - F.col("c")
    )

    def at(rank):
        return F.max(F.when((F.col("start") <= rank) & (rank < F.col("upto")), F.col("v")))

    aggs = []
    for i, p in enumerate(probs):
        pos = F.lit(p) * last
        aggs += [at(F.floor(pos)).alias(f"_lo{i}"), at(F.ceil(pos)).alias(f"_hi{i}")]
    found = inside.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)
    out = []
    for i, p in enumerate(probs):
        frac = F.lit(p) * last - F.floor(F.lit(p) * last)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((lo + (hi - lo) * frac).alias(quantile_name(p)))
    kept = [k for k in keys if k != "_all"]
    return found.select(*kept, *out)
