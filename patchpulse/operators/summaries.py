"""Summaries of an hour that can be added up for any window, so that windows are answered without reading rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .risk import threshold_methods

#: Size of a quantile sketch. The rank of an answer is off by at most 0.4 % of the rows with a confidence of 99 %.
QUANTILE_K = 800
#: Binary logarithm of the registers of a distinct count; its relative standard error is 1.04 / sqrt(2 ** 14) = 0.8 %.
DISTINCT_LG = 14


def hourly_summaries(rows: DataFrame, value: str, person: str, keys: tuple[str, ...] = ("appid",), ts: str = "ts") -> DataFrame:
    """keys, hour, n (values), total and square (exact), values (quantile sketch), people (distinct sketch, NULL where nobody is named).

    Rows without a value or a time are left out. Sketches combine before the shuffle, so a hot key is no hot task.
    """
    known = rows.where(F.col(value).isNotNull() & F.col(ts).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    return known.groupBy(*keys, F.date_trunc("hour", ts).alias("hour")).agg(
        F.count("*").alias("n"), F.sum("_v").alias("total"), F.sum(F.col("_v") * F.col("_v")).alias("square"),
        F.kll_sketch_agg_double("_v", QUANTILE_K).alias("values"),
        F.hll_sketch_agg(F.col(person).cast("string"), DISTINCT_LG).alias("people"))


def merged(summaries: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Summaries added up over ``keys`` (columns or expressions such as a day); the result can be merged again."""
    return summaries.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("square").alias("square"),
        F.kll_merge_agg_double("values", QUANTILE_K).alias("values"), F.hll_union_agg("people").alias("people"))


def described(summaries: DataFrame, probs: tuple[float, ...] = (0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """n, mean and sd (exact), n_people and quantiles p50, p75, ... (within the errors stated above) in place of the sketches."""
    n, mu = F.col("n"), F.col("total") / F.col("n")
    variance = (F.col("square") - n * mu * mu) / F.nullif(n - 1, F.lit(0))
    kept = [c for c in summaries.columns if c not in ("total", "square", "values", "people")]
    return summaries.select(
        *kept, mu.alias("mean"), F.coalesce(F.sqrt(F.greatest(variance, F.lit(0.0))), F.lit(0.0)).alias("sd"),
        F.hll_sketch_estimate("people").alias("n_people"),
        *[F.kll_sketch_get_quantile_double("values", F.lit(p)).alias(f"p{p * 100:g}") for p in probs])


def window_thresholds(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Level cuts by the four methods of ``risk.derive_thresholds`` for the hours given, from their summaries alone."""
    one = described(merged(summaries, keys), (0.75, 0.95, 0.99))
    base = one.select(*keys, F.array("p75", "p95", "p99").alias("q"), F.col("mean").alias("mu"), "sd")
    return threshold_methods(base, keys)
