"""Streaming forms of scoring, ingest and monitoring, from the same column expressions as the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .. import config
from ..plans import monitor
from ..session import fresh_path
from ..sources import reviews as review_source


def read_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """Rows of Parquet files as they land in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def score_stream(reviews: DataFrame, levels: tuple[str, ...] = ("Critical", "High"),
                 cuts: config.LevelCuts = config.FIXED_CUTS) -> DataFrame:
    """Score every arriving review and keep those of the given levels; stateless."""
    return monitor.score_rows(reviews, cuts=cuts).where(F.col("risk_level").isin(*levels))


def dedup_stream(reviews: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop repeated (appid, review_id) that arrive within the delay; state is bounded by the watermark."""
    return reviews.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["appid", "review_id"])


def ingest_stream(reviews: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Append only reviews the store does not have yet, whenever they arrive.

    Every micro-batch goes through the batch ingest, whose anti join makes a replayed batch a no-op.
    """

    def one(batch: DataFrame, _: int) -> None:
        review_source.ingest_reviews(batch, store)

    return (
        reviews.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def hourly_labels(scored: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Label counts and mean score per app and hour (tumbling); later rows than the delay are dropped."""
    rows = scored.withWatermark("ts", delay).groupBy("appid", F.window("ts", "1 hour").alias("w"))
    return rows.agg(
        F.count("*").alias("n_reviews"),
        *[F.count_if(F.col("sentiment_label") == v).alias(f"n_{v}") for v in ("positive", "neutral", "negative")],
        F.sum("score").alias("sum_score"),
    ).select("appid", F.col("w.start").alias("hour"), "n_reviews", "n_positive", "n_neutral", "n_negative", "sum_score")


def sliding_rate(events: DataFrame, width: str = "24 hours", step: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Rows per app in a window that slides by ``step``."""
    rows = events.withWatermark("ts", delay).groupBy("appid", F.window("ts", width, step).alias("w"))
    return rows.agg(F.count("*").alias("n_rows")).select("appid", F.col("w.end").alias("window_end"), "n_rows")


def volume_alerts(events: DataFrame, baseline: DataFrame, factor: float = 3.0, delay: str = "1 hour") -> DataFrame:
    """Hours whose volume exceeds ``factor`` times the app's baseline rate per hour (a static table)."""
    rows = events.withWatermark("ts", delay).groupBy("appid", F.window("ts", "1 hour").alias("w"))
    hourly = rows.agg(F.count("*").alias("n_rows")).select("appid", F.col("w.start").alias("hour"), "n_rows")
    return hourly.join(baseline, "appid").where(F.col("n_rows") > factor * F.col("baseline_per_hour"))


def run_to_parquet(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything that is available now and return what was written."""
    spark = stream.sparkSession
    out, checkpoint = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    started = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
