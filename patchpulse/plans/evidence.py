"""Readable context per update and the deterministic fallback narrative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators.windows import top_per_group

KEYS = ["appid", "update_id"]
PRIORITIES = ("P1", "P2", "P3")


def _lines(df: DataFrame, order: str, line: Column, name: str) -> DataFrame:
    """One multi-line text per update from a few rows (already cut to a top k)."""
    picked = df.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("_x"))
    return picked.select(*KEYS, F.concat_ws("\n", F.transform("_x", lambda x: x["l"])).alias(name))


def patch_context(updates: DataFrame, notes: DataFrame, k: int = 3, chars: int | None = None) -> DataFrame:
    """Title, day and contents of the k newest patch notes since each update's window began; ``chars`` cuts the contents."""
    from ..operators.windows import with_bounds

    # The newest k notes of a day are all a later cut to k can need; this bounds the pairs per update and day.
    per_day = top_per_group(
        notes.withColumn("_day", F.to_date("published_at")), ["appid", "_day"], k, [F.desc("published_at"), F.asc("gid")], "_r")
    joined = with_bounds(updates).select(*KEYS, "window_start").join(per_day, "appid").where(
        F.col("published_at") >= F.col("window_start"))
    top = top_per_group(joined, KEYS, k, [F.desc("published_at"), F.asc("gid")], "_rank")
    body = F.col("contents") if chars is None else F.substring("contents", 1, chars)
    line = F.concat(F.col("title"), F.lit(", "), F.date_format("published_at", "yyyy-MM-dd"), F.lit("\n"), body)
    return _lines(top, "_rank", line, "patch_context")


def evidence_pack(summary: DataFrame, topics: DataFrame, context: DataFrame, app_names: DataFrame | None = None,
                  themes: DataFrame | None = None, quotes: DataFrame | None = None, distribution: DataFrame | None = None) -> DataFrame:
    """One text per update from what is known of it, a section each; sections without content are left out.

    ``topics`` and ``themes`` (label, count) are shown by size, eight and six of them; ``quotes`` (text, sentiment, position) ten in
    page order; ``distribution`` gives a ``summary`` of the reviews after the update.
    """
    extras = {
        "_topics": (topics, 8, [F.desc("count"), F.asc("label")], F.format_string("- %s: %d", "label", "count")),
        "_themes": (themes, 6, [F.desc("count"), F.asc("label")], F.format_string("- %s: %d", "label", "count")),
        "_quotes": (quotes, 10, [F.asc("position"), F.asc("text")], F.format_string('- %s: "%s"', "sentiment", "text")),
    }
    joined = summary.join(context, KEYS, "left")
    for name, (rows, k, by, line) in extras.items():
        if rows is None:
            joined = joined.withColumn(name, F.lit(None).cast("string"))
        else:
            joined = joined.join(_lines(top_per_group(rows, KEYS, k, by, "_rank"), "_rank", line, name), KEYS, "left")
    if distribution is None:
        joined = joined.withColumn("_spread", F.lit(None).cast("string"))
    else:
        joined = joined.join(distribution.select(*KEYS, F.col("summary").alias("_spread")), KEYS, "left")
    title = F.concat(F.lit("App "), F.col("appid"))
    if app_names is not None:
        joined = joined.join(app_names.select("appid", F.col("name").alias("_name")), "appid", "left")
        title = F.coalesce("_name", title)

    def section(name: str, *lines: Column) -> Column:
        body = F.concat_ws("\n", *lines)
        return F.when(body != "", F.concat(F.lit(f"\n# {name}\n"), body))

    def shares(w: str) -> Column:
        return F.format_string(
            "%d reviews: %s positive, %s neutral, %s negative", F.col(f"{w}_n"), *[text.percent(F.col(f"{w}_{v}"), 1) for v in ("positive", "neutral", "negative")])

    disagree = F.col("n_disagreements")
    fired = F.concat_ws("\n", F.transform(
        "signals", lambda s: F.format_string("- %s (%s): %s", s["rule"], s["severity"], s["description"])))
    pack = F.concat_ws(
        "\n", F.format_string("%s, update %s, risk %s", title, F.col("update_id"), F.col("overall_risk")),
        section("Before the update", shares("pre")),
        section("Announcement comments", F.when(F.col("n_comments").isNotNull(), F.format_string(
            "%d comments, %s negative", F.col("n_comments"), text.percent(F.col("comment_negative")))), F.col("_themes"), F.col("_quotes")),
        section(
            "After the update", F.when(F.col("post_n") > 0, shares("post")),
            F.when(F.col("post_n") > 0, F.concat(F.lit("Change of the negative share: "), text.signed_percent(F.col("sentiment_delta")))),
            F.when(disagree > 0, F.format_string(
                "%d reviews (%s) whose text contradicts the vote", disagree, text.percent(disagree / F.col("post_n"), 1))), F.col("_spread")),
        section("Topics", F.col("_topics")), section("Signals", fired), section("Patch notes", F.col("patch_context")))
    return joined.select(*KEYS, pack.alias("evidence"))


def fallback_narrative(summary: DataFrame) -> DataFrame:
    """The sentence reported when no narrative was generated."""
    # Fixed value: the wording of the fallback.
    line = F.format_string(
        "Analysis complete. Risk level: %s. Negative ratio change: %s.", "overall_risk",
        text.signed_percent(F.col("sentiment_delta")))
    return summary.select(*KEYS, line.alias("narrative"))


def group_actions(items: DataFrame) -> DataFrame:
    """Action items (priority, issue, action, expected_impact) per update in priority order; other priorities drop."""
    known = items.where(F.col("priority").isin(*PRIORITIES))
    return known.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("priority", "issue", "action", "expected_impact"))).alias("items"))
