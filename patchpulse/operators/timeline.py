"""Time-ordered operators that never put one app into one task.

Spark's sliding frames re-evaluate the whole frame for every row, and partitioning by app sends a hot app to one
task. Here time is cut into hours. The rows of ``(t - w, t]`` are

* the rows of t's own hour up to t (a running aggregate inside (app, hour)),
* the whole hours in between (from a small table with one row per app and hour), and
* the rows of the hour of ``t - w`` after ``t - w`` (a running aggregate from the end of that hour).

Counts, sums, squares, minima and maxima of the three parts add up exactly, so every window costs the same
however many rows it spans, and the work is split by (app, hour).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..session import materialise

HOUR = 3_600_000_000
DAY = 24 * HOUR
PARTS = ("n", "s", "q", "neg", "pos", "lo", "hi")


def micros(ts: Column | str) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def _aggregates(score: Column, cut: float, window=None) -> dict[str, Column]:
    """The additive parts over rows with a score."""
    raw = {
        "n": F.count(score),
        "s": F.sum(score),
        "q": F.sum(score * score),
        "neg": F.count(F.when(score < -cut, 1)),
        "pos": F.count(F.when(score > cut, 1)),
        "lo": F.min(score),
        "hi": F.max(score),
    }
    return {k: (v.over(window) if window is not None else v) for k, v in raw.items()}


def _merge(name: str, value: Column) -> Column:
    if name == "lo":
        return F.min(value)
    if name == "hi":
        return F.max(value)
    return F.coalesce(F.sum(value), F.lit(0))


def anchored_parts(data: DataFrame, anchors: DataFrame | None, score: str, row_id: str, key: str = "appid",
                   ts: str = "ts", widths: tuple[int, ...] = config.ROLLING_HOURS, side: str = "before",
                   cut: float = config.RATIO_CUT, inclusive_cut: bool = False, buckets_per_hour: int = 1) -> DataFrame:
    """Additive parts of the score over one window per anchor and width (hours).

    ``side='before'``: rows of (t - w, t], equal times included. ``side='after'``: rows of [t, t + w].
    With ``anchors=None`` every data row is an anchor. ``buckets_per_hour`` cuts time finer where a single hour of one
    app is too much for a task. Returns key, row_id, _hour, ts_us and for every width the
    columns n_w, s_w, q_w, neg_w, pos_w, lo_w, hi_w.
    """
    shift = 1e-12 if inclusive_cut else 0.0
    rows = data.select(
        F.col(key).alias("key"), F.col(row_id).alias("id"), micros(ts).alias("us"), F.col(score).cast("double").alias("v")
    ).where("us IS NOT NULL")
    own = anchors is None
    marks = rows.drop("v") if own else anchors.select(
        F.col(key).alias("key"), F.col(row_id).alias("id"), micros(ts).alias("us")
    ).where("us IS NOT NULL")
    step = HOUR // buckets_per_hour
    hour = F.floor(F.col("us") / step)
    sign = -1 if side == "before" else 1

    # Small table: one row per key and hour, with the sums of the whole hours inside each window.
    grid = rows.select("key", hour.alias("hour"), "v")
    if not own:
        grid = grid.unionByName(marks.select("key", hour.alias("hour")).distinct(), allowMissingColumns=True)
    hourly = grid.groupBy("key", "hour").agg(*[c.alias(k) for k, c in _aggregates(F.col("v"), cut - shift).items()])
    by_hour = Window.partitionBy("key").orderBy("hour")
    middle = hourly.select(
        "key", "hour",
        *[
            (F.min if p == "lo" else F.max if p == "hi" else F.sum)(p).over(
                by_hour.rangeBetween(1 - w * buckets_per_hour, -1) if side == "before"
                else by_hour.rangeBetween(1, w * buckets_per_hour - 1)
            ).alias(f"m_{p}_{w}")
            for w in widths for p in PARTS
        ],
    )

    # Rows and look-ups share the (key, hour) partitions. kind: 0 data, 1 look-up.
    # 'P' asks for rows up to its time, 'S' for rows from its time on.
    near, far = ("P", "S") if side == "before" else ("S", "P")

    def ask(kind: str, w: int) -> Column:
        at = F.col("us") + sign * w * HOUR
        return F.struct(
            F.floor(at / step).alias("bucket"), at.alias("at"), F.lit(kind).alias("kind"), F.lit(w).alias("w"),
            F.lit(own and w == 0).alias("is_row"),
        )

    # Every anchor becomes its look-ups in one pass; a row that is its own anchor doubles as the near look-up.
    asked = marks if not own else rows
    stream = asked.withColumn("home", hour).select(
        "key", "id", "us", "home", *(["v"] if own else []),
        F.inline(F.array(ask(near, 0), *[ask(far, w) for w in widths])),
    )
    if own:
        stream = stream.withColumn("v", F.when(F.col("is_row"), F.col("v")))
    else:
        stream = rows.select("key", hour.alias("bucket"), F.col("us").alias("at"), "v").unionByName(
            stream, allowMissingColumns=True
        )
    upto = Window.partitionBy("key", "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    # From the end of the hour: strictly later rows for 'before', equal times included for 'after'.
    last = -1 if side == "before" else 0
    since = Window.partitionBy("key", "bucket").orderBy(-F.col("at")).rangeBetween(Window.unboundedPreceding, last)
    v = F.col("v")
    pre, suf = _aggregates(v, cut - shift, upto), _aggregates(v, cut - shift, since)
    answered = stream.withColumns(
        {f"p_{k}": c for k, c in pre.items()} | {f"t_{k}": c for k, c in suf.items()}
    ).where("id IS NOT NULL")
    flat = answered.select(
        "key", "home", "id", "us", "w",
        *[F.when(F.col("kind") == "P", F.col(f"p_{p}")).otherwise(F.col(f"t_{p}")).alias(p) for p in PARTS],
    ).repartition("key", "home")
    merged = flat.groupBy("key", "home", "id").agg(
        F.max("us").alias("ts_us"),
        *[_merge(p, F.when(F.col("w").isin(0, w), F.col(p))).alias(f"{p}_{w}") for w in widths for p in PARTS],
    )
    joined = merged.join(middle.withColumnRenamed("hour", "home"), ["key", "home"], "left")
    out = []
    for w in widths:
        for p in PARTS:
            a, m = F.col(f"{p}_{w}"), F.col(f"m_{p}_{w}")
            if p == "lo":
                c = F.least(a, m)
            elif p == "hi":
                c = F.greatest(a, m)
            else:
                c = a + F.coalesce(m, F.lit(0))
            out.append(c.alias(f"{p}_{w}"))
    return joined.select(F.col("key").alias(key), F.col("id").alias(row_id), F.col("home").alias("_hour"), "ts_us", *out)


def mean_of(w: int) -> Column:
    return F.when(F.col(f"n_{w}") > 0, F.col(f"s_{w}") / F.col(f"n_{w}"))


def std_of(w: int) -> Column:
    n, s, q = F.col(f"n_{w}"), F.col(f"s_{w}"), F.col(f"q_{w}")
    var = F.when(n > 1, (q - s * s / n) / (n - 1))
    # Clear the noise that the difference of squares leaves behind on constant windows.
    return F.when(var > 1e-12, F.sqrt(var)).when(var.isNotNull(), F.lit(0.0))


def share_of(part: str, w: int) -> Column:
    return F.when(F.col(f"n_{w}") > 0, F.col(f"{part}_{w}") / F.col(f"n_{w}"))


def as_of_latest(left: DataFrame, right: DataFrame, right_ts: str, key: str = "appid", ts: str = "ts",
                 name: str = "latest_ts") -> DataFrame:
    """Add the latest right time at or before each left row's time, per key.

    Both sides are cut into days. A carry table (one row per key and day) brings the last right time of earlier
    days, so each (key, day) is independent of the others.
    """
    day_of = F.floor(F.col("_us") / DAY)
    r = right.select(F.col(key), micros(right_ts).alias("_us")).where("_us IS NOT NULL").withColumn("_day", day_of)
    per_day = r.groupBy(key, "_day").agg(F.max("_us").alias("_last"))
    lt = left.withColumn("_us", micros(ts)).withColumn("_day", day_of)
    days = per_day.unionByName(lt.select(key, "_day").distinct(), allowMissingColumns=True)
    days = days.groupBy(key, "_day").agg(F.max("_last").alias("_last"))
    earlier = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carry = days.select(key, "_day", F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    stream = lt.withColumn("_left", F.lit(True)).unionByName(
        r.dropDuplicates([key, "_us"]).withColumn("_right", F.col("_us")), allowMissingColumns=True
    )
    seen = Window.partitionBy(key, "_day").orderBy("_us").rangeBetween(Window.unboundedPreceding, 0)
    out = stream.withColumn("_seen", F.max("_right").over(seen)).where("_left").join(carry, [key, "_day"], "left")
    found = F.timestamp_micros(F.coalesce("_seen", "_carry"))
    return out.withColumn(name, found).select(*left.columns, name)


def align_to_latest_patch(comments: DataFrame, news: DataFrame, ts: str = "ts") -> DataFrame:
    """latest_news_date and hours_since_latest_news (NULL without an earlier item)."""
    out = as_of_latest(comments, news, "published_at", ts=ts, name="latest_news_date")
    gap = (micros(ts) - micros("latest_news_date")) / HOUR
    return out.withColumn("hours_since_latest_news", gap)


def news_windows(news: DataFrame, comments: DataFrame, score: str = "score",
                 widths: tuple[int, ...] = config.ROLLING_HOURS) -> DataFrame:
    """Comment count, mean score and negative/positive shares in the first w hours after every news item."""
    anchors = news.select("appid", "gid", F.col("published_at").alias("ts"))
    data = comments.select("appid", "ts", F.col(score).alias("score"), F.lit(None).cast("string").alias("gid"))
    parts = anchored_parts(data, anchors, "score", "gid", widths=widths, side="after", inclusive_cut=True)
    cols = []
    for w in widths:
        cols += [
            F.col(f"n_{w}").alias(f"count_in_{w}h"), mean_of(w).alias(f"avg_sent_in_{w}h"),
            share_of("neg", w).alias(f"neg_ratio_in_{w}h"), share_of("pos", w).alias(f"pos_ratio_in_{w}h"),
        ]
    return parts.select("appid", "gid", *cols)


def rolling_features(events: DataFrame, score: str = "score", row_id: str = "event_id", ts: str = "ts",
                     widths: tuple[int, ...] = config.ROLLING_HOURS, buckets_per_hour: int = 1) -> DataFrame:
    """Rolling mean, std, min, max, negative/positive shares and rate of every row and width."""
    parts = anchored_parts(events, None, score, row_id, ts=ts, widths=widths, buckets_per_hour=buckets_per_hour)
    cols = []
    for w in widths:
        cols += [
            mean_of(w).alias(f"sentiment_rolling_mean_{w}h"), std_of(w).alias(f"sentiment_rolling_std_{w}h"),
            F.col(f"lo_{w}").alias(f"sentiment_rolling_min_{w}h"), F.col(f"hi_{w}").alias(f"sentiment_rolling_max_{w}h"),
            share_of("neg", w).alias(f"neg_ratio_rolling_{w}h"), share_of("pos", w).alias(f"pos_ratio_rolling_{w}h"),
            F.col(f"n_{w}").alias(f"comment_rate_{w}h"),
        ]
    return parts.select("appid", row_id, "_hour", "ts_us", *cols)


def rolling_mean(events: DataFrame, value: str, name: str, row_id: str = "event_id", ts: str = "ts",
                 widths: tuple[int, ...] = config.ROLLING_HOURS) -> DataFrame:
    """Rolling mean of any further column (engagement, toxicity)."""
    parts = anchored_parts(events, None, value, row_id, ts=ts, widths=widths)
    return parts.select("appid", row_id, *[mean_of(w).alias(f"{name}_rolling_{w}h") for w in widths])


def trend_features(rolled: DataFrame, row_id: str = "event_id",
                   widths: tuple[int, ...] = config.ROLLING_HOURS) -> DataFrame:
    """Changes from row to row of the rolling features: diff, acceleration, rate change, peaks, direction, volatility.

    Neighbours inside an hour come from a window on (app, hour); the edges of an hour come from a table of each
    hour's first row and last two rows.
    """
    rolled = materialise(rolled)
    w_in = Window.partitionBy("appid", "_hour").orderBy("ts_us", row_id)
    carried = [f"sentiment_rolling_mean_{w}h" for w in widths] + [f"comment_rate_{w}h" for w in widths]
    here = F.struct(*carried)
    size = F.count("*").over(Window.partitionBy("appid", "_hour"))
    near = rolled.withColumns({
        "_here": here, "_rn": F.row_number().over(w_in), "_size": size,
        "_p1": F.lag(here, 1).over(w_in), "_p2": F.lag(here, 2).over(w_in), "_n1": F.lead(here, 1).over(w_in),
    })
    edges = near.where("_rn = 1 OR _rn >= _size - 1").groupBy("appid", "_hour").agg(
        F.max(F.when(F.col("_rn") == 1, F.col("_here"))).alias("first"),
        F.max(F.when(F.col("_rn") == F.col("_size"), F.col("_here"))).alias("last"),
        F.max(F.when(F.col("_rn") == F.col("_size") - 1, F.col("_here"))).alias("second"),
    )
    hours = Window.partitionBy("appid").orderBy("_hour")
    prev_last, prev_second = F.lag("last", 1).over(hours), F.lag("second", 1).over(hours)
    edges = edges.select(
        "appid", "_hour", prev_last.alias("_e1"), F.coalesce(prev_second, F.lag("last", 2).over(hours)).alias("_e2"),
        F.lead("first", 1).over(hours).alias("_en"),
    )
    full = near.join(edges, ["appid", "_hour"], "left").withColumns({
        "_b1": F.coalesce("_p1", "_e1"),
        "_b2": F.when(F.col("_rn") >= 3, F.col("_p2")).when(F.col("_rn") == 2, F.col("_e1")).otherwise(F.col("_e2")),
        "_a1": F.coalesce("_n1", "_en"),
    })
    cols = {}
    for w in widths:
        m, r = f"sentiment_rolling_mean_{w}h", f"comment_rate_{w}h"
        diff = F.col(m) - F.col(f"_b1.{m}")
        cols[f"sentiment_diff_{w}h"] = diff
        cols[f"sentiment_acceleration_{w}h"] = diff - (F.col(f"_b1.{m}") - F.col(f"_b2.{m}"))
        cols[f"comment_rate_change_{w}h"] = (F.col(r) - F.col(f"_b1.{r}")) / F.nullif(F.col(f"_b1.{r}"), F.lit(0))
    w0, w2 = widths[0], widths[-1]
    m0, m2 = f"sentiment_rolling_mean_{w0}h", f"sentiment_rolling_mean_{w2}h"
    before, after, now = F.col(f"_b1.{m0}"), F.col(f"_a1.{m0}"), F.col(m0)
    # Differences below the noise of a float sum are no movement.
    eps = F.lit(1e-9)
    cols["is_sentiment_local_peak"] = F.coalesce((now > before + eps) & (now > after + eps), F.lit(False)).cast("int")
    cols["is_sentiment_local_trough"] = F.coalesce((now < before - eps) & (now < after - eps), F.lit(False)).cast("int")
    out = full.withColumns(cols)
    slope = F.col(f"sentiment_diff_{w2}h")
    out = out.withColumns({
        "sentiment_trend_direction": F.when(F.abs(slope) <= eps, 0).when(slope > 0, 1).when(slope < 0, -1),
        "sentiment_volatility": F.col(f"sentiment_rolling_std_{w2}h") / (F.abs(m2) + 0.01),
    })
    return out.drop("_here", "_rn", "_size", "_p1", "_p2", "_n1", "_e1", "_e2", "_en", "_b1", "_b2", "_a1")


def add_hourly_count(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows of the same app and hour, on every row."""
    hour = F.date_trunc("hour", ts)
    counts = events.groupBy("appid", hour.alias("_h")).agg(F.count("*").alias("hourly_count"))
    return events.withColumn("_h", hour).join(counts, ["appid", "_h"]).drop("_h")


def fill_missing_times(rows: DataFrame, ts: str = "ts", order: str = "event_id", block: int = 4096) -> DataFrame:
    """Forward-fill missing times along ``order`` (a number) inside each app; leading gaps stay NULL.

    Blocks of ``order`` are filled on their own; the last known time of earlier blocks is carried over.
    """
    tagged = rows.withColumn("_block", F.floor(F.col(order) / block))
    ends = tagged.groupBy("appid", "_block").agg(
        F.max(F.when(F.col(ts).isNotNull(), F.struct(F.col(order), F.col(ts))))[ts].alias("_end")
    )
    earlier = Window.partitionBy("appid").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("appid", "_block", F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    inside = Window.partitionBy("appid", "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = tagged.withColumn("_in", F.last(ts, ignorenulls=True).over(inside)).join(carry, ["appid", "_block"], "left")
    return filled.withColumn(ts, F.coalesce("_in", "_carry")).drop("_in", "_carry", "_block")
