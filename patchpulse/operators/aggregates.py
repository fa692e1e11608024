"""Per-update statistics. Everything here is a partial-then-final aggregate, so hot apps are reduced map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions import text
from ..session import materialise
from .windows import top_per_group

UPDATE_KEYS = ["appid", "update_id"]
LABELS = ("positive", "neutral", "negative")


def share(cond: Column) -> Column:
    """Fraction of rows for which ``cond`` holds; 0.0 without rows."""
    return F.coalesce(F.count_if(cond) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))


def sentiment_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """mean_compound, label shares and n_reviews per group."""
    return df.groupBy(*keys).agg(
        F.avg("compound").alias("mean_compound"),
        *[F.avg((F.col("sentiment_label") == v).cast("double")).alias(f"{v}_pct") for v in LABELS],
        F.count("*").alias("n_reviews"),
    )


def window_stats(tagged: DataFrame, updates: DataFrame, keys: list[str] = UPDATE_KEYS,
                 extra: list[Column] | None = None) -> DataFrame:
    """One row per update with pre_* and post_* statistics (zeros for empty windows) and the negative delta.

    ``extra`` aggregates ride along in the same pass.
    """
    aggs = list(extra or [])
    for w in ("pre", "post"):
        n = f"count_if(window = '{w}')"
        aggs += [F.expr(f"{n} AS {w}_n"), F.expr(f"avg(if(window = '{w}', compound, NULL)) AS {w}_mean")]
        aggs += [
            F.expr(f"count_if(window = '{w}' AND sentiment_label = '{v}') / nullif({n}, 0) AS {w}_{v}") for v in LABELS
        ]
    stats = tagged.groupBy(*keys).agg(*aggs)
    full = updates.select(*keys).join(stats, keys, "left").na.fill(0)
    return full.withColumn(
        "sentiment_delta", F.expr("if(post_n > 0, bround(post_negative - pre_negative, 4), 0D) + 0D")
    )


def topic_counts(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and share of every topic label per group."""
    per_label = tagged.groupBy(*keys, F.col("topic").alias("label")).agg(F.count("*").alias("count"))
    # One row per label from here, so the total is a window over a handful of rows and the texts are read once.
    total = F.sum("count").over(Window.partitionBy(*keys))
    return per_label.withColumn("pct", F.bround(F.col("count") / total, 4))


def merge_announcement_themes(topics: DataFrame, themes: DataFrame, keys: list[str], k: int | None = None) -> DataFrame:
    """Topic counts together with announcement themes (prefixed, share 0), ranked by size; all, or the k largest per group.

    A group has a row per label, so ranking moves few rows.
    """
    marked = themes.select(
        *keys, F.concat(F.lit("[announcement] "), "label").alias("label"), "count", F.lit(0.0).alias("pct")
    )
    both = topics.select(*keys, "label", "count", "pct").unionByName(marked)
    by = [F.desc("count"), F.asc("label")]
    if k is not None:
        return top_per_group(both, keys, k, by)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))


def exact_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Median of a column with few distinct values (rounded scores): counted first, so no group is collected."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_freq"))
    return counted.groupBy(*keys).agg(F.percentile(value, F.lit(0.5), F.col("_freq")).alias(name))


def distribution_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Readable description of the raw rows of every group: votes, short texts and compound statistics."""
    content = F.col("review_content")
    # Only votes, scores and the short texts are needed; they are kept so that scoring happens once.
    df = materialise(df.select(
        *keys, "voted_up", "compound", F.when(F.length(content) < 10, content).alias("review_content")))
    base = df.groupBy(*keys).agg(
        F.count("*").alias("n_total"),
        F.count_if(F.col("voted_up")).alias("n_recommended"),
        F.count("review_content").alias("n_short"),
        F.avg("compound").alias("mean_compound"),
        F.stddev_samp("compound").alias("std_compound"),
    )
    median = exact_median(df, keys, "compound", "median_compound")
    short = (
        df.where(content.isNotNull())
        .groupBy(*keys, text.strip_blank(content).alias("short_text"))
        .agg(F.count("*").alias("n"))
    )
    top = top_per_group(short, keys, 8, [F.desc("n"), F.asc("short_text")]).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", "short_text", "n"))).alias("top_short")
    )
    joined = base.join(median, keys, "left").join(top, keys, "left")
    shown = F.concat_ws(", ", F.transform("top_short", lambda s: F.format_string('%d x "%s"', s["n"], s["short_text"])))
    n, yes = F.col("n_total"), F.col("n_recommended")
    votes = F.format_string("Of %d reviews, %s (%d) recommend the product and %s (%d) advise against it.", n, text.percent(yes / n), yes, text.percent((n - yes) / n), n - yes)
    brief = F.when(F.col("n_short") > 0, F.format_string("Shorter than ten characters: %d, above all %s.", "n_short", shown))
    scores = F.format_string("Sentiment is %+.3f on average, %+.3f in the middle, and deviates by %.3f.",
                             "mean_compound", "median_compound", F.coalesce("std_compound", F.lit(float("nan"))))
    lines = F.concat_ws("\n", votes, brief, scores)
    return joined.withColumn("summary", lines).withColumn("top_short", shown)


def merge_themes(themes: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """Sum the counts of equal labels (trimmed, lower-cased; a missing count is 1); the k largest per group."""
    label = F.lower(text.strip_blank("label"))
    summed = (
        themes.withColumn("label", label).where("label <> ''")
        .groupBy(*keys, "label").agg(F.sum(F.coalesce("count", F.lit(1))).alias("count"))
    )
    return top_per_group(summed, keys, k, [F.desc("count"), F.asc("label")])


def pick_quotes(quotes: DataFrame, keys: list[str], order: str, k: int = 10) -> DataFrame:
    """The first k distinct quote texts of every group; copies are folded by an aggregate, not by a window."""
    body = quotes.withColumn("text", text.strip_blank("text")).where("text <> ''")
    first = body.groupBy(*keys, "text").agg(
        F.min(F.struct(F.col(order), F.col("sentiment"))).alias("_first")
    )
    flat = first.select(*keys, "text", F.col(f"_first.{order}").alias(order), F.col("_first.sentiment").alias("sentiment"))
    return top_per_group(flat, keys, k, [F.asc(order), F.asc("text")])


def comment_stats(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Totals and shares over analysed chunks (positive, negative, neutral, total); failed chunks keep their size."""
    out = chunks.groupBy(*keys).agg(
        F.sum("total").alias("n_comments"),
        *[F.sum(v).alias(f"{v}_count") for v in LABELS],
        F.count("*").alias("n_chunks"),
        F.count_if(F.col("positive") + F.col("negative") + F.col("neutral") > 0).alias("n_analysed"),
    )
    n = F.greatest("n_comments", F.lit(1))
    return out.withColumns({f"{v}_pct": F.bround(F.col(f"{v}_count") / n, 4) for v in LABELS})


def store_summary(reviews: DataFrame, ts: str = "ts") -> DataFrame:
    """Row count and time range per app."""
    return reviews.groupBy("appid").agg(
        F.count("*").alias("n_reviews"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    )


def topic_ids(comments: DataFrame) -> DataFrame:
    """Comments per app and topic."""
    return comments.groupBy("appid", "forum_topic_id").agg(F.count("*").alias("n_comments"))


def daily_sentiment(tagged: DataFrame) -> DataFrame:
    """Mean compound per app, day and window."""
    return tagged.groupBy("appid", F.to_date("ts").alias("day"), "window").agg(
        F.avg("compound").alias("mean_compound"), F.count("*").alias("n_reviews")
    )


def coverage_report(updates: DataFrame, tagged: DataFrame, store: DataFrame, notes: DataFrame, comments: DataFrame,
                    now: Column, warn_after_days: int = 30) -> DataFrame:
    """Rows per window, notes and comments of every update, whether the store covers the window, and a warning."""
    from .windows import with_bounds

    counts = tagged.groupBy(*UPDATE_KEYS).agg(
        F.count_if(F.col("window") == "pre").alias("n_pre"), F.count_if(F.col("window") == "post").alias("n_post")
    )
    bounds = with_bounds(updates)
    u = (
        bounds.join(counts, UPDATE_KEYS, "left")
        .join(store.select("appid", "first_ts", "last_ts"), "appid", "left")
        .join(notes_since(updates, notes), UPDATE_KEYS, "left")
        .join(comments.groupBy("appid").agg(F.count("*").alias("n_comments")), "appid", "left")
        .na.fill(0, ["n_pre", "n_post", "n_notes", "n_comments"])
    )
    age = F.datediff(now, F.col("update_ts"))
    missing = F.concat_ws(
        " or ", F.when(F.col("n_pre") == 0, F.lit("pre-update")), F.when(F.col("n_post") == 0, F.lit("post-update"))
    )
    warning = F.when(
        (age > warn_after_days) & (missing != ""),
        F.format_string("WARN: update is %d days old, no %s reviews", age, missing),
    )
    return u.select(
        *UPDATE_KEYS, "n_pre", "n_post", "n_notes", "n_comments", age.alias("age_days"),
        F.coalesce(
            (F.col("first_ts") <= F.col("window_start")) & (F.col("last_ts") >= F.col("window_end")), F.lit(False)
        ).alias("window_covered"),
        warning.alias("warning"),
    )


def notes_since(updates: DataFrame, notes: DataFrame) -> DataFrame:
    """Patch notes published since the start of each update's window.

    Notes are counted per app and day first, so the join sees day rows; the boundary day is counted exactly.
    """
    from .windows import with_bounds

    u = with_bounds(updates).select(*UPDATE_KEYS, "window_start")
    per_second = notes.groupBy("appid", F.col("published_at")).agg(F.count("*").alias("n"))
    per_day = per_second.groupBy("appid", F.to_date("published_at").alias("_day")).agg(F.sum("n").alias("n"))
    later_days = (
        u.join(per_day, "appid").where(F.col("_day") > F.to_date("window_start"))
        .groupBy(*UPDATE_KEYS).agg(F.sum("n").alias("n_later"))
    )
    first_day = (
        u.withColumn("_day", F.to_date("window_start"))
        .join(per_second.withColumn("_day", F.to_date("published_at")), ["appid", "_day"])
        .where(F.col("published_at") >= F.col("window_start"))
        .groupBy(*UPDATE_KEYS).agg(F.sum("n").alias("n_first"))
    )
    joined = u.join(later_days, UPDATE_KEYS, "left").join(first_day, UPDATE_KEYS, "left")
    return joined.select(
        *UPDATE_KEYS, (F.coalesce("n_later", F.lit(0)) + F.coalesce("n_first", F.lit(0))).alias("n_notes")
    )


def kpi_row(with_signals: DataFrame) -> DataFrame:
    """Headline numbers of every update (statistics with signals)."""
    return with_signals.select(
        *UPDATE_KEYS,
        F.col("post_n").alias("post_reviews"),
        (F.col("post_n") - F.col("pre_n")).alias("post_reviews_change"),
        F.col("post_negative").alias("negative_pct"),
        (F.col("post_negative") - F.col("pre_negative")).alias("negative_pct_change"),
        "sentiment_delta",
        "overall_risk",
    )


def feature_summary(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """count, mean, std, min and max of every numeric feature, labelled with its feature group; one pass."""
    names = [(g, c) for g, cols in groups.items() for c in cols]
    aggs = []
    for _, c in names:
        v = F.col(c).cast("double")
        aggs.append(
            F.struct(
                F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"), F.max(v).alias("max"),
            ).alias(c)
        )
    wide = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(g).alias("feature_group"), F.lit(c).alias("feature"), F.col(c).alias("s")) for g, c in names
    ])
    return wide.select(F.explode(rows).alias("r")).select("r.feature_group", "r.feature", "r.s.*")
