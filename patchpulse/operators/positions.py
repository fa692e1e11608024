"""Row numbers inside groups that do not put a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_position(df: DataFrame, keys: list[str], bucket: Column, order: list[str], name: str) -> DataFrame:
    """1-based position of every row inside its group, without putting a group into one task.

    ``bucket`` must not decrease along ``order``. Rows are numbered inside (group, bucket) and shifted by the
    number of rows in earlier buckets, which comes from a small table of counts.
    """
    tagged = df.withColumn("_bucket", bucket)
    sizes = tagged.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    shift = F.coalesce(
        F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    sizes = sizes.withColumn("_shift", shift).drop("_n")
    inner = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    numbered = tagged.withColumn("_inner", inner).join(sizes, [*keys, "_bucket"])
    return numbered.withColumn(name, (F.col("_inner") + F.col("_shift")).cast("bigint")).drop(
        "_bucket", "_inner", "_shift"
    )
