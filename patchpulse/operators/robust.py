"""Minimum covariance determinant: location and scatter of the most concentrated share of the rows, and distances from it."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Percentiles are exact up to so many distinct distances; beyond, their rank is off by this share at most.
ACCURACY = 100_000


@dataclass(frozen=True)
class Scatter:
    centre: np.ndarray
    covariance: np.ndarray
    log_det: float


def chi2_cdf(x: float, k: float) -> float:
    """Share of a chi-square distribution below x, by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while abs(term) > 1e-16 * abs(total):
        n += 1
        term *= z / (a + n)
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, k: float) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, k) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return (low + high) / 2


def consistency(share: float, k: int) -> float:
    """What the covariance of the nearest ``share`` of normal rows must be multiplied by to be that of all."""
    return share / chi2_cdf(chi2_quantile(share, k), k + 2)


def squared_distance(names: list[str], s: Scatter) -> Column:
    inverse = np.linalg.pinv(s.covariance)
    d = [F.col(c) - F.lit(float(m)) for c, m in zip(names, s.centre)]
    k = len(names)
    parts = [d[i] * d[j] * F.lit(float(inverse[i, j]) * (1 if i == j else 2)) for i in range(k) for j in range(i, k)]
    return reduce(lambda a, b: a + b, parts)


def _scatter(row, prefix: str, k: int) -> Scatter:
    n = row[f"{prefix}n"] or 1
    centre = np.array([(row[f"{prefix}m{i}"] or 0.0) / n for i in range(k)])
    cov = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            cov[i, j] = cov[j, i] = (row[f"{prefix}c{i}_{j}"] or 0.0) / n - centre[i] * centre[j]
    sign, log_det = np.linalg.slogdet(cov)
    return Scatter(centre, cov, float(log_det) if sign > 0 else -math.inf)


def concentrate(rows: DataFrame, names: list[str], share: float, scatters: list[Scatter]) -> list[Scatter]:
    """One step for all starts at once: of each, the scatter of the ``share`` of rows nearest to it. Two aggregates over the rows."""
    k = len(names)
    far = [squared_distance(names, s) for s in scatters]
    cuts = rows.agg(*[F.percentile_approx(d, share, ACCURACY).alias(f"q{i}") for i, d in enumerate(far)]).first()
    sums = []
    for s, d in enumerate(far):
        near = d <= F.lit(cuts[f"q{s}"])
        sums.append(F.count_if(near).alias(f"s{s}n"))
        sums += [F.sum(F.when(near, F.col(names[i]))).alias(f"s{s}m{i}") for i in range(k)]
        sums += [F.sum(F.when(near, F.col(names[i]) * F.col(names[j]))).alias(f"s{s}c{i}_{j}") for i in range(k) for j in range(i, k)]
    row = rows.agg(*sums).first()
    return [_scatter(row, f"s{s}", k) for s in range(len(scatters))]


def minimum_covariance(rows: DataFrame, names: list[str], share: float = 0.75, starts: int = 10, finalists: int = 2,
                       most_steps: int = 30) -> Scatter:
    """Location and scatter of the ``share`` of rows whose covariance has the least determinant, made consistent for normal rows.

    Starts are small groups of rows, chosen by a hash of their values (``starts`` times five rows a column: bounded). All take two concentration steps
    together; the best go on until the determinant no longer falls. Rows with a null are left out. Fewer rows than columns, or
    columns without spread, give a pseudo-inverse of what there is.
    """
    k = len(names)
    rows = rows.select(*names).dropna()
    size = 5 * k
    picked = rows.orderBy(F.xxhash64(*names), *names).limit(starts * size).collect()
    data = np.array([[r[c] for c in names] for r in picked], float).reshape(-1, k)
    scatters = []
    for s in range(starts):
        part = data[s::starts]
        if len(part) > k:
            scatters.append(Scatter(part.mean(axis=0), np.cov(part.T, bias=True).reshape(k, k), math.inf))
    if not scatters:
        part = data if len(data) else np.zeros((1, k))
        return Scatter(part.mean(axis=0), np.cov(part.T, bias=True).reshape(k, k), -math.inf)
    for _ in range(2):
        scatters = concentrate(rows, names, share, scatters)
    scatters = sorted(scatters, key=lambda s: s.log_det)[:finalists]
    for _ in range(most_steps):
        moved = concentrate(rows, names, share, scatters)
        settled = all(not m.log_det < s.log_det - 1e-12 for m, s in zip(moved, scatters))
        scatters = moved
        if settled:
            break
    best = min(scatters, key=lambda s: s.log_det)
    return Scatter(best.centre, best.covariance * consistency(share, k), best.log_det)
