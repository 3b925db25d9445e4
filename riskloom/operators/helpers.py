"""Small numpy helpers for what Spark has no built-in for; each works on one series or block inside a task."""

from __future__ import annotations

import math

import numpy as np


def t_tail(t, df) -> np.ndarray:
    """Two-sided tails of Student's t, by the continued fraction of the incomplete beta function; NaN without a degree of freedom."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    good = (df >= 1) & np.isfinite(t)
    t, n = np.where(good, t, 0.0), np.where(good, df, 1.0)
    return np.where(good, _beta_inc(n / 2, np.full(n.shape, 0.5), n / (n + t * t)), np.nan)


def _beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    turned = x > (a + 1) / (a + b + 2)  # the fraction converges fast on one side of this
    a, b, x = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(gamma(a + b) - gamma(a) - gamma(b) + a * np.log(inside) + b * np.log1p(-inside)) / a
    tiny = 1e-300
    safe = lambda v: np.where(v == 0, tiny, v)
    c, d = np.ones_like(x), 1 / safe(1 - (a + b) * inside / (a + 1))
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (b - m) * inside / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * inside / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / safe(1 + num * d), safe(1 + num / c)
            step = d * c
            h = h * step
        if (np.abs(step - 1) < 1e-15).all():
            break
    value = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, front * h))
    return np.where(turned, 1 - value, value)


def smooth(v: np.ndarray) -> np.ndarray:
    """Local quadratics over an odd window of at most 7 points; the first and last half windows take the edge fit."""
    n = len(v)
    if n < 5:
        return v
    w = min(n - 1, 7)
    w -= 1 - w % 2
    half = w // 2
    fit = np.vander(np.arange(w), 3)
    hat = fit @ np.linalg.pinv(fit)
    out = np.empty(n)
    rows = np.lib.stride_tricks.sliding_window_view(v, w)
    out[half : n - half] = rows @ hat[half]
    out[:half], out[n - half :] = hat[:half] @ v[:w], hat[half + 1 :] @ v[-w:]
    return out


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The not-a-knot cubic spline through (x, y), also beyond its ends; straight lines for fewer than four points."""
    n = len(x)
    if n < 4:
        return np.interp(at, x, y)
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    a, r = np.zeros((n, n)), np.zeros(n)  # second derivatives
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * (slope[i] - slope[i - 1])
    m = np.linalg.solve(a, r)
    k = np.clip(np.searchsorted(x, at) - 1, 0, n - 2)
    d = at - x[k]
    b = slope[k] - h[k] * (2 * m[k] + m[k + 1]) / 6
    return y[k] + d * (b + d * (m[k] / 2 + d * (m[k + 1] - m[k]) / (6 * h[k])))


def nan_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances over the features both rows have, scaled up to all features; inf without any."""
    va, vb = ~np.isnan(a), ~np.isnan(b)
    x, y = np.where(va, a, 0), np.where(vb, b, 0)
    sq = (x * x) @ vb.T + va @ (y * y).T - 2 * x @ y.T
    shared = va.astype(float) @ vb.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, np.sqrt(np.maximum(sq, 0) * a.shape[1] / shared), np.inf)
