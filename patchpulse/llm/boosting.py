"""Small gradient-boosted trees for yes/no targets, in numpy."""

from __future__ import annotations

import numpy as np


def cuts_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Bin edges of each feature at its quantiles."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1).astype(np.int64)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 32, rate: float = 0.2, ridge: float = 1.0) -> dict:
    """Trees of full depth: ``feature`` and ``cut`` of each inner node in level order, ``leaf`` values in log-odds."""
    cuts = cuts_of(x, bins)
    b = binned(x, cuts)
    n, width = b.shape
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    raw = np.full(n, base)
    out = {"base": base, "depth": depth, "feature": [], "cut": [], "leaf": []}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        features, values = [], []
        for level in range(depth):
            nodes = 1 << level
            gain, best_f, best_c = np.zeros(nodes), np.zeros(nodes, np.int64), np.full(nodes, bins, np.int64)
            for f in range(width):
                key = at * (bins + 1) + b[:, f]
                gs = np.bincount(key, g, nodes * (bins + 1)).reshape(nodes, -1).cumsum(1)
                hs = np.bincount(key, h, nodes * (bins + 1)).reshape(nodes, -1).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                score = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                k = score.argmax(1)
                top = score[np.arange(nodes), k]
                better = top > gain + 1e-9
                gain[better], best_f[better], best_c[better] = top[better], f, k[better]
            features += best_f.tolist()
            values += [float(cuts[f][c]) if c < len(cuts[f]) else float("inf") for f, c in zip(best_f, best_c)]
            at = 2 * at + (b[np.arange(n), best_f[at]] > best_c[at])
        leaf = rate * np.bincount(at, g, 1 << depth) / (np.bincount(at, h, 1 << depth) + ridge)
        raw += leaf[at]
        for name, v in (("feature", features), ("cut", values), ("leaf", leaf.tolist())):
            out[name].append(v)
    return out | {k: np.array(out[k]) for k in ("feature", "cut", "leaf")}


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    raw, rows = np.full(len(x), model["base"]), np.arange(len(x))
    for feature, cut, leaf in zip(model["feature"], model["cut"], model["leaf"]):
        at = np.zeros(len(x), np.int64)
        for level in range(model["depth"]):
            node = at + (1 << level) - 1
            at = 2 * at + (x[rows, feature[node]] > cut[node])
        raw += leaf[at]
    return raw
