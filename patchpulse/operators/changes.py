"""Level shifts and spikes in hourly counts: penalised segmentation by a pruned dynamic program over prefix sums."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

HOUR = 3600
SHORTEST = 6
FOUND = "kind string, at bigint, n bigint, before double, after double"


def poisson_cost(counts: np.ndarray) -> Callable[[np.ndarray, int], np.ndarray]:
    """Twice the negative log-likelihood of segments [start, end) at their own rate, up to a constant; from prefix sums."""
    total = np.concatenate(([0.0], np.cumsum(counts, dtype=float)))

    def cost(starts: np.ndarray, end: int) -> np.ndarray:
        s = total[end] - total[starts]
        n = end - starts
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(s > 0, 2 * s * (1 - np.log(s / n)), 0.0)

    return cost


def segment_starts(counts: np.ndarray, penalty: float, shortest: int = SHORTEST) -> list[int]:
    """Starts of all segments but the first, of the segmentation with the least cost plus ``penalty`` for each segment.

    The last change before each end is chosen among the starts that can still be best; a start is dropped once even without a
    penalty it cannot win any more (splitting a segment never costs more), so the work grows about linearly with the series.
    """
    n = len(counts)
    cost = poisson_cost(counts)
    best, last = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    best[0] = -penalty
    gone = np.full(n + 1, n + 1)  # the end from which a start need not be tried any more
    live = np.zeros(0, np.int64)
    for end in range(shortest, n + 1):
        if np.isfinite(best[end - shortest]):
            live = np.append(live, end - shortest)
        live = live[gone[live] > end]
        value = best[live] + cost(live, end)
        k = int(np.argmin(value))
        best[end], last[end] = value[k] + penalty, live[k]
        beaten = live[value > best[end]]
        gone[beaten] = np.minimum(gone[beaten], end + shortest)  # by a segment that starts here, once it is long enough
    out, at = [], n
    while at > 0 and np.isfinite(best[n]):
        at = int(last[at])
        out.append(at)
    return sorted(x for x in out if x > 0)


def above(counts: np.ndarray, usual: np.ndarray, sigma: float) -> np.ndarray:
    return counts > usual + sigma * np.sqrt(np.maximum(usual, 1))


def bursts(counts: np.ndarray, sigma: float, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray]:
    """Hours above the median of the hours around them by ``sigma`` Poisson deviations, and that median for each hour.

    The median looks ``shortest`` hours either way, so what lasts that long is a level and moves it, and anything shorter stands out.
    """
    around = np.lib.stride_tricks.sliding_window_view(np.pad(counts, shortest, mode="symmetric"), 2 * shortest + 1)
    middle = np.median(around, axis=1)
    return np.flatnonzero(above(counts, middle, sigma)), middle


def detect_changes(rows: DataFrame, ts: str = "ts", penalty: float | None = None, sigma: float = 5.0, shortest: int = SHORTEST) -> DataFrame:
    """``appid``, ``hour``, ``kind`` (shift or spike), ``n_rows``, and for shifts the rate before and after.

    Rows become counts per app and hour by a partial aggregate; what is handed to one function call is an app's series of hours, whose length depends on
    the span of time and not on the number of rows. Hours without rows count as 0. ``penalty`` is 3 ln(hours) unless given. A shift starts a level
    that lasts ``shortest`` hours or longer; shorter bursts are taken out of the levels, and hours ``sigma``
    Poisson deviations above their level's median are spikes. Rows without app or time are left out.
    """
    ship_package(rows.sparkSession)
    hour = F.floor(F.unix_seconds(ts) / HOUR)
    hourly = rows.where(F.col("appid").isNotNull() & F.col(ts).isNotNull()).groupBy("appid", hour.alias("h")).agg(F.count("*").alias("n"))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["h"].min())
        counts = np.zeros(int(pdf["h"].max()) - first + 1, np.int64)
        counts[pdf["h"].to_numpy() - first] = pdf["n"]
        spikes, middle = bursts(counts, sigma, shortest)
        level = counts.copy()
        level[spikes] = middle[spikes]
        starts = segment_starts(level, 3 * math.log(max(len(counts), 2)) if penalty is None else penalty, shortest)
        edges = [0, *starts, len(counts)]
        rate = [float(level[a:b].mean()) for a, b in zip(edges, edges[1:])]
        found = [("shift", first + s, int(counts[s]), rate[i], rate[i + 1]) for i, s in enumerate(starts)]
        usual = np.repeat([np.median(level[a:b]) for a, b in zip(edges, edges[1:])], np.diff(edges))
        found += [("spike", first + int(s), int(counts[s]), math.nan, math.nan) for s in np.flatnonzero(above(counts, usual, sigma))]
        return pd.DataFrame([(key[0], *f) for f in found], columns=["appid", "kind", "at", "n", "before", "after"])

    out = hourly.groupBy("appid").applyInPandas(one, f"appid string, {FOUND}")
    return out.select("appid", F.timestamp_seconds(F.col("at") * HOUR).alias("hour"), "kind", F.col("n").alias("n_rows"),
                      F.nanvl("before", F.lit(None)).alias("rate_before"), F.nanvl("after", F.lit(None)).alias("rate_after"))
