"""Probabilities that Spark has no function for, in numpy and math; used on k x k blocks and small result tables."""

from __future__ import annotations

import math

import numpy as np


def gamma_q(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function, by its series or its continued fraction."""
    if x <= 0 or a <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * front)
    b, c = x + 1 - a, 1e300
    d = h = 1.0 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_p(statistic: float, dof: int) -> float:
    return gamma_q(dof / 2, statistic / 2) if dof > 0 else 1.0


def ks_p(statistic: float, n: int, m: int) -> float:
    """The two-sample p value from the Kolmogorov series."""
    lam = statistic * math.sqrt(n * m / (n + m))
    if lam < 1e-3:
        return 1.0
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101)))))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    if k <= 0:
        return 1.0
    if p <= 0 or k > n:
        return 0.0
    if p >= 1:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def chi2_counts(a: np.ndarray, b: np.ndarray, scale: int = 1000) -> tuple[float, float]:
    """Statistic and p of two probability vectors as truncated counts; columns of zeros go, Yates for one degree."""
    table = np.array([(a * scale).astype(int), (b * scale).astype(int)], float)
    table = table[:, table.sum(axis=0) > 0]
    if table.shape[1] < 2 or (table.sum(axis=1) == 0).any():
        return 0.0, 1.0
    expected = np.outer(table.sum(axis=1), table.sum(axis=0)) / table.sum()
    diff = np.abs(table - expected)
    if table.shape[1] == 2:
        diff = np.maximum(diff - np.minimum(0.5, diff), 0)
    statistic = float((diff**2 / expected).sum())
    return statistic, chi2_p(statistic, table.shape[1] - 1)


def permutation_p(a: np.ndarray, b: np.ndarray, n: int = 1000, seed: int = 42) -> float:
    """Of the L1 distance, over shuffles of the pooled cells; at least 1/n."""
    rng = np.random.default_rng(seed)
    pooled = np.concatenate([a, b])
    seen = np.abs(a - b).sum()
    shuffled = rng.permuted(np.tile(pooled, (n, 1)), axis=1)
    d = np.abs(shuffled[:, : len(a)] - shuffled[:, len(a) :]).sum(axis=1)
    return float(max((d >= seen - 1e-12).mean(), 1.0 / n))


def knee(x: np.ndarray, y: np.ndarray) -> int:
    """The place farthest from the chord of the normalised curve."""
    u = (x - x.min()) / max(np.ptp(x), 1e-12)
    v = (y - y.min()) / max(np.ptp(y), 1e-12)
    return int(np.argmax(np.abs((v[-1] - v[0]) * u - (u[-1] - u[0]) * v + u[-1] * v[0] - v[-1] * u[0])))


def ward_linkage(points: np.ndarray) -> np.ndarray:
    """Merges (a, b, height, size) of Ward's method, by nearest clusters with the Lance-Williams update; for few points."""
    n = len(points)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    size, ids, out = np.ones(n), np.arange(n), []
    alive = np.ones(n, bool)
    for step in range(n - 1):
        masked = np.where(alive[:, None] & alive[None], d, np.inf)
        i, j = divmod(int(masked.argmin()), n)
        h = d[i, j]
        si, sj = size[i], size[j]
        new = np.sqrt(np.maximum(((si + size) * d[i] ** 2 + (sj + size) * d[j] ** 2 - size * h**2) / (si + sj + size), 0))
        out.append((min(ids[i], ids[j]), max(ids[i], ids[j]), h, si + sj))
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        alive[j] = False
        size[i], ids[i] = si + sj, n + step
    return np.array(out, float)


def average_linkage_labels(similarity: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters by average linkage on 1 - similarity; for few points."""
    n = len(similarity)
    d = 1.0 - similarity
    d = d.astype(float)
    np.fill_diagonal(d, np.inf)
    label, size, alive = np.arange(n), np.ones(n), np.ones(n, bool)
    for _ in range(n - k):
        masked = np.where(alive[:, None] & alive[None], d, np.inf)
        i, j = divmod(int(masked.argmin()), n)
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, i] = np.inf
        label[label == j] = i
        size[i] += size[j]
        alive[j] = False
    return np.unique(label, return_inverse=True)[1]
