"""Small linear models on dense features: ridge logistic regression, out-of-fold probabilities, calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass(frozen=True)
class Logistic:
    """Weights on standardised features; with one class in the labels, its share and no weights."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w + self.b

    def p(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.score(x))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 300, standard: bool = True, default: float = 0.5) -> Logistic:
    """Accelerated gradient descent on the mean loss; deterministic for the same rows in the same order."""
    d = x.shape[1]
    weight = np.ones(len(y)) if weight is None else weight
    share = float(np.average(y, weights=weight)) if len(y) and weight.sum() > 0 else default
    flat = Logistic(np.zeros(d, np.float32), np.ones(d, np.float32), np.zeros(d, np.float32), float(logit(np.array(share))))
    if len(y) == 0 or share in (0.0, 1.0):
        return flat
    mean = x.mean(axis=0, dtype=np.float64).astype(np.float32) if standard else np.zeros(d, np.float32)
    scale = x.std(axis=0, dtype=np.float64).astype(np.float32) if standard else np.ones(d, np.float32)
    scale = np.where(scale > 1e-6, scale, 1).astype(np.float32)
    z = ((x - mean) / scale).astype(np.float32)
    q = (weight / weight.sum()).astype(np.float32)
    v = np.ones(d, np.float32) / np.sqrt(d)
    for _ in range(20):
        u = z.T @ (q * (z @ v))
        top = float(np.linalg.norm(u))
        v = u / max(top, 1e-12)
    rate = 1 / (0.25 * (1.1 * top + 1) + ridge)
    w = old = np.zeros(d, np.float32)
    b = old_b = float(logit(np.array(share)))
    for t in range(steps):
        m = t / (t + 3)
        aw, ab = w + m * (w - old), b + m * (b - old_b)
        r = q * (sigmoid(z @ aw + ab) - y).astype(np.float32)
        old, old_b = w, b
        w, b = (aw - rate * (z.T @ r + ridge * aw)).astype(np.float32), ab - rate * float(r.sum())
    return Logistic(mean, scale, w, b)


def out_of_fold(x: np.ndarray, y: np.ndarray, fold: np.ndarray, weight: np.ndarray | None = None, own: np.ndarray | None = None, **kind) -> np.ndarray:
    """Scores of each row by a model that never saw its fold. ``own``: the rows to score; the others only train."""
    out = np.zeros(len(y))
    own = np.ones(len(y), dtype=bool) if own is None else own
    for k in np.unique(fold):
        train, test = fold != k, (fold == k) & own
        model = fit(x[train], y[train], None if weight is None else weight[train], **kind)
        out[test] = model.score(x[test])
    return out


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn scores into calibrated log-odds."""
    if len(y) == 0 or y.min() == y.max():
        return 1.0, 0.0
    m = fit(score[:, None].astype(np.float32), y, ridge=1e-4)
    a = float(m.w[0] / m.scale[0])
    return a, float(m.b - a * m.mean[0])


@dataclass(frozen=True)
class Pool:
    """What pseudo-labelled rows say about a model, to second order around the weights ``at`` (the intercept last): weight, gradient and curvature of their loss."""

    at: np.ndarray
    weight: float
    g: np.ndarray
    h: np.ndarray


def weights_of(m: Logistic) -> np.ndarray:
    return np.append(m.w.astype(float), m.b)


def rows_of(m: Logistic, x: np.ndarray) -> np.ndarray:
    """Standardised features and a column of ones."""
    return np.hstack([(x - m.mean) / m.scale, np.ones((len(x), 1))]).astype(float)


def refit(m: Logistic, x: np.ndarray, y: np.ndarray, pool: Pool, share: float, ridge: float = 1e-3, steps: int = 6) -> Logistic:
    """``m`` moved by damped Newton steps to the least loss of the rows and of a pool; the pool weighs at most ``share`` of the rows."""
    z, w = rows_of(m, x), weights_of(m)
    part = min(1.0, share * len(y) / pool.weight) if pool.weight > 0 else 0.0
    total = len(y) + part * pool.weight
    keep = np.append(np.full(len(w) - 1, ridge * total), 1e-9)

    def loss(w):
        s, d = z @ w, w - pool.at
        return np.logaddexp(0, s).sum() - s @ y + part * (pool.g @ d + 0.5 * d @ pool.h @ d) + 0.5 * (keep * w) @ w

    now = loss(w)
    for _ in range(steps):
        p = sigmoid(z @ w)
        g = z.T @ (p - y) + part * (pool.g + pool.h @ (w - pool.at)) + keep * w
        h = (z * (p * (1 - p))[:, None]).T @ z + part * pool.h + np.diag(keep + 1e-9 * total)
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-3 and (after := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-3:
            break
        w, now = w - size * step, after
    return Logistic(m.mean, m.scale, w[:-1].astype(np.float32), float(w[-1]))
