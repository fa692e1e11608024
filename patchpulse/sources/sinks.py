"""Result files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cleaning import flag_rows


def write_scored(scored: DataFrame, summary: DataFrame, path: str) -> None:
    """All scored rows as Parquet, the summary as JSON and the high-risk rows as CSV below ``path``."""
    scored.write.mode("overwrite").partitionBy("appid").parquet(f"{path}/scored")
    summary.write.mode("overwrite").json(f"{path}/summary")
    high = scored.where(F.col("risk_level").isin("Critical", "High"))
    high.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/high_risk")


def alert_markdown(alerts: DataFrame) -> DataFrame:
    """One Markdown line per alert (column value)."""
    line = F.format_string(
        "- **%s** %s / %s: %s = %.4f (threshold %.4f)", "severity", "appid", "update_id", "rule",
        F.col("value").cast("double"), F.col("threshold").cast("double"),
    )
    return alerts.select(line.alias("value"))


def write_alerts(alerts: DataFrame, path: str) -> None:
    """Alerts as JSON and as Markdown."""
    alerts.write.mode("overwrite").json(f"{path}/json")
    alert_markdown(alerts).write.mode("overwrite").text(f"{path}/markdown")


def write_groups(groups: DataFrame, path: str) -> None:
    """Coordinated groups as JSON."""
    groups.write.mode("overwrite").json(path)


def write_cleaned(reviews: DataFrame, path: str) -> None:
    """All rows with their exclusion flag, partitioned by it: readers take the variant with or without flagged rows."""
    variant = F.when(F.col("is_removed_cleaning") == 1, "flagged").otherwise("kept")
    flag_rows(reviews).withColumn("flag_variant", variant).write.mode("overwrite").partitionBy("flag_variant").parquet(path)


def read_cleaned(spark, path: str, include_flagged: bool = False) -> DataFrame:
    df = spark.read.parquet(path)
    return df if include_flagged else df.where("flag_variant = 'kept'")
