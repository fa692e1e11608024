"""Statistical, model-based and combined anomaly scores, and the trend alert built on them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.features import flag
from ..session import materialise, save_table
from . import robust
from .quantiles import exact_quantiles


def detect_statistical(df: DataFrame, keys: list[str], sensitivity: str = "medium", score: str = "compound") -> DataFrame:
    """0/1 anomaly flags against the group's mean and deviation, their sum, and the verdict (two or more).

    Needs ``hourly_count``; votes (votes_up, text_length), dominant_topic and sentiment_diff_24h are used when
    present. The rare-topic flag is reported but does not count.
    """
    sigma = config.SENSITIVITY_SIGMA[sensitivity]
    out = df = save_table(df, "rows")  # read again for the statistics
    tested = {"is_sentiment_anomaly": (score, True), "is_volume_anomaly": ("hourly_count", False)}
    if {"votes_up", "text_length"} <= set(df.columns):
        out = out.withColumn("votes_per_char", F.col("votes_up") / (F.col("text_length") + 1))
        tested["is_vote_anomaly"] = ("votes_per_char", False)
    if "sentiment_diff_24h" in df.columns:
        tested["is_trend_anomaly"] = ("sentiment_diff_24h", True)
    aggs = []
    for c, _ in tested.values():
        aggs += [F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}")]
    out = out.join(out.groupBy(*keys).agg(*aggs, F.count("*").alias("_rows")), keys)
    flags = {}
    for name, (c, two_sided) in tested.items():
        off = F.col(c).cast("double") - F.col(f"_m_{c}")
        flags[name] = flag((F.abs(off) if two_sided else off) > sigma * F.col(f"_s_{c}"))
    out = out.withColumns(flags)
    if "dominant_topic" in df.columns:
        freq = out.groupBy(*keys, "dominant_topic").agg(F.count("*").alias("_freq"))
        out = out.join(freq, [*keys, "dominant_topic"], "left").withColumn(
            "is_rare_topic", flag(F.col("_freq") / F.col("_rows") < 0.05)
        ).drop("_freq")
    total = reduce(lambda a, b: a + b, [F.col(n) for n in flags])
    out = out.withColumn("statistical_anomaly_score", total)
    out = out.withColumn("is_statistical_anomaly", flag(F.col("statistical_anomaly_score") >= 2))
    return out.drop("_rows", *[f"_{k}_{c}" for c, _ in tested.values() for k in "ms"])


def column_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with its exact median; all columns go through one pass in long form."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    tall = df.select(F.explode(pairs).alias("p")).select("p.feature", "p.value")
    return exact_quantiles(tall, "value", (0.5,), ("feature",))


def impute_features(df: DataFrame, numeric: list[str], strings: list[str] = ()) -> DataFrame:
    """NULL numbers become the column median over all rows, NULL strings ''."""
    medians = column_medians(df, numeric).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "p50"))).alias("m")
    )  # one entry per column
    out = df.withColumn("_medians", medians.scalar())
    out = out.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.try_element_at("_medians", F.lit(c))) for c in numeric
    })
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in strings}).drop("_medians") if strings else out.drop(
        "_medians")


def _flag_top(df: DataFrame, contamination: float) -> DataFrame:
    cut = exact_quantiles(df, "ml_anomaly_score", (1 - contamination,))
    name = cut.columns[0]
    return df.withColumn("_cut", cut.select(name).scalar()).withColumn(
        "ml_anomaly", flag(F.col("ml_anomaly_score") > F.col("_cut"))
    ).drop("_cut")


def _standardised(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    filled = impute_features(save_table(df, "features"), features)  # a cheap projection of the written rows
    stats = filled.agg(F.struct(*[
        F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in features
    ])).scalar()
    names = [f"_z{i}" for i in range(len(features))]
    out = filled.withColumn("_st", stats)
    out = out.withColumns({
        z: F.when(F.col(f"_st.{c}.s") > 0, (F.col(c) - F.col(f"_st.{c}.m")) / F.col(f"_st.{c}.s")).otherwise(0.0)
        for z, c in zip(names, features)
    })
    return out.drop("_st"), names


def detect_elliptic(df: DataFrame, features: list[str], contamination: float = 0.05) -> DataFrame:
    """Squared Mahalanobis distance of the imputed, standardised features; the farthest share is flagged.

    The covariance is one aggregate row (features x features numbers); its inverse goes back as constants.
    """
    z, names = _standardised(df, features)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = z.agg(*[F.avg(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).first()
    cov = np.zeros((len(names), len(names)))
    for (i, j), v in zip(pairs, row):
        cov[i, j] = cov[j, i] = v or 0.0
    precision = np.linalg.pinv(cov)
    distance = reduce(lambda a, b: a + b, [
        F.col(names[i]) * F.col(names[j]) * F.lit(float(precision[i, j]) * (1.0 if i == j else 2.0)) for i, j in pairs
    ])
    return _flag_top(z.withColumn("ml_anomaly_score", distance).drop(*names), contamination)


def detect_robust(df: DataFrame, features: list[str], contamination: float = 0.05, share: float = 0.75) -> DataFrame:
    """As ``detect_elliptic``, from the centre and covariance of the most concentrated ``share`` of the rows, which outliers do not move."""
    z, names = _standardised(df, features)
    z = materialise(z)
    scatter = robust.minimum_covariance(z, names, share)
    distance = robust.squared_distance(names, scatter)
    return _flag_top(z.withColumn("ml_anomaly_score", distance).drop(*names), contamination)


TREE = "tree int, node int, feature int, cut double, leaf_size int, depth int"


def _grow_tree(pdf: pd.DataFrame, names: list[str], limit: int) -> pd.DataFrame:
    """Random splits down to single rows or the depth limit; nodes are numbered like a heap."""
    tree = int(pdf["tree"].iloc[0])
    rng = np.random.default_rng(tree)
    data = pdf.sort_values("_pick")[names].to_numpy()
    rows, todo = [], [(1, 0, np.arange(len(data)))]
    while todo:
        node, depth, idx = todo.pop()
        part = data[idx]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(idx) > 1 else []
        if depth >= limit or len(spread) == 0:
            rows.append((tree, node, -1, 0.0, len(idx), depth))
            continue
        f = int(rng.choice(spread))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        rows.append((tree, node, f, cut, 0, depth))
        left = part[:, f] < cut
        todo += [(2 * node, depth + 1, idx[left]), (2 * node + 1, depth + 1, idx[~left])]
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "cut", "leaf_size", "depth"])


def _expected_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 2.0)
    return np.where(n > 1, 2 * (np.log(big - 1) + 0.5772156649) - 2 * (big - 1) / big, 0.0)


def detect_isolation(df: DataFrame, features: list[str], row_id: str, n_trees: int = 100, sample: int = 256,
                     contamination: float = 0.05) -> DataFrame:
    """Isolation-forest score (higher is stranger). Every tree is grown in its own task from ``sample`` rows.

    The sample is the rows with the smallest hash of their id; trees are bounded by n_trees x 2 x sample nodes.
    """
    z, names = _standardised(df, features)
    z = z.withColumn("_pick", F.xxhash64(row_id))
    picked = z.orderBy("_pick", row_id).limit(n_trees * sample).select(*names, "_pick")
    grouped = picked.withColumn("tree", F.pmod(F.shiftright("_pick", 8), F.lit(n_trees)).cast("int"))
    limit = int(np.ceil(np.log2(sample)))
    forest = grouped.groupBy("tree").applyInPandas(lambda p: _grow_tree(p, names, limit), schema=TREE)
    nodes = forest.toPandas()  # bounded: n_trees * 2 * sample rows
    size = max(1, int(min(sample, nodes[nodes["feature"] < 0].groupby("tree")["leaf_size"].sum().mean())))
    trees = []
    for _, t in nodes.groupby("tree"):
        width = int(t["node"].max()) + 1
        f, c, d = np.full(width, -1), np.zeros(width), np.zeros(width)
        f[t["node"]], c[t["node"]] = t["feature"], t["cut"]
        d[t["node"]] = t["depth"] + _expected_path(t["leaf_size"].to_numpy())
        trees.append((f, c, d))
    shared = df.sparkSession.sparkContext.broadcast(trees)
    norm = float(_expected_path(np.array([size]))[0]) or 1.0

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy() for c in cols])
        total = np.zeros(len(x))
        for f, c, d in shared.value:
            at = np.ones(len(x), dtype=int)
            for _ in range(limit):
                inner = f[at] >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(f[at], 0)] >= c[at]
                at = np.where(inner, 2 * at + go, at)
            total += d[at]
        return pd.Series(np.power(2.0, -(total / len(shared.value)) / norm))

    return _flag_top(z.withColumn("ml_anomaly_score", score(*names)).drop(*names, "_pick"), contamination)


def _min_max(c: str, stats: str) -> Column:
    lo, hi = F.col(f"{stats}.lo_{c}"), F.col(f"{stats}.hi_{c}")
    return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.0)


def _range_of(df: DataFrame, columns: list[str]) -> Column:
    return df.agg(F.struct(*[
        f(c).cast("double").alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))
    ])).scalar()


def detect_combined(df: DataFrame, ml_weight: float = 0.6, q_medium: float = 0.8, q_high: float = 0.95) -> DataFrame:
    """ensemble_anomaly_score from the model score and the number of flags, with a 0-1 severity and its level."""
    parts = ["ml_anomaly_score", "statistical_anomaly_score"]
    out = df.withColumn("_r", _range_of(df, parts)).withColumn(
        "ensemble_anomaly_score", _min_max(parts[0], "_r") * ml_weight + _min_max(parts[1], "_r") * (1 - ml_weight)
    ).drop("_r")
    # The severity is the ensemble score on a scale from 0 to 1, so its quantiles are those of the score on the same scale.
    cuts = exact_quantiles(out, "ensemble_anomaly_score", (q_medium, q_high))
    medium, high = cuts.columns
    out = out.withColumns({"_r": _range_of(out, ["ensemble_anomaly_score"]), "_q": cuts.select(F.struct("*")).scalar()})
    s, eps = F.col("ensemble_anomaly_score"), F.lit(1e-12)
    level = (
        F.when(s + eps >= F.col(f"_q.{high}"), "high").when(s + eps >= F.col(f"_q.{medium}"), "medium").otherwise("low")
    )
    return out.withColumns({
        "anomaly_severity_score": _min_max("ensemble_anomaly_score", "_r"), "anomaly_severity": level}).drop("_r", "_q")


def trend_alerts(df: DataFrame, widths: tuple[int, ...] = config.ROLLING_HOURS, min_triggers: int = 3,
                 scope: tuple[str, ...] = ()) -> DataFrame:
    """trigger_count and trend_alert: how many of seven measures reach their 95th percentile.

    The percentiles are taken over all rows or, with ``scope`` (such as the app), over the rows of the same scope, so that a large
    app does not set the cuts of the others.
    """
    measures = {"ensemble_anomaly_score": F.col("ensemble_anomaly_score")}
    for w in widths:
        measures[f"sentiment_diff_{w}h"] = F.abs(f"sentiment_diff_{w}h")
        measures[f"comment_rate_change_{w}h"] = F.abs(f"comment_rate_change_{w}h")
    pairs = F.array(*[F.struct(F.lit(n).alias("measure"), c.cast("double").alias("value")) for n, c in measures.items()])
    tall = df.select(*scope, F.explode(pairs).alias("p")).select(*scope, "p.measure", "p.value")
    cuts = exact_quantiles(tall, "value", (0.95,), (*scope, "measure")).groupBy(*scope).agg(
        F.map_from_entries(F.collect_list(F.struct("measure", "p95"))).alias("_cuts")
    )  # one entry per measure
    out = df.join(cuts, list(scope), "left") if scope else df.withColumn("_cuts", cuts.scalar())
    hits = reduce(lambda a, b: a + b, [
        flag(c + 1e-12 >= F.try_element_at("_cuts", F.lit(n))) for n, c in measures.items()
    ])
    out = out.withColumn("trigger_count", hits).drop("_cuts")
    return out.withColumn("trend_alert", flag(F.col("trigger_count") >= min_triggers))


def composite_alert(df: DataFrame) -> DataFrame:
    """Any of: weak risk label, trend alert, statistical anomaly, model anomaly, coordinated behaviour (those that are present)."""
    causes = ("risk_label_weak", "trend_alert", "is_statistical_anomaly", "ml_anomaly", "is_coordinated")
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) == 1, F.lit(False)) for c in causes if c in df.columns])
    return df.withColumn("composite_alert", hit.cast("int"))
