"""Tail probabilities in NumPy, evaluated a column at a time inside tasks."""

from __future__ import annotations

import math

import numpy as np


def lgamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    return np.array([math.lgamma(v) for v in x.ravel()]).reshape(x.shape)


def gamma_sf(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones(a.shape)
    ok = np.isfinite(a) & np.isfinite(x) & (a > 0)
    out[~ok] = np.nan
    low = ok & (x > 0) & (x < a + 1)
    if low.any():
        al, xl = a[low], x[low]
        term = 1.0 / al
        total = term.copy()
        for n in range(1, 100_000):
            term = term * xl / (al + n)
            total += term
            if np.all(np.abs(term) <= np.abs(total) * 1e-15):
                break
        out[low] = 1.0 - total * np.exp(al * np.log(xl) - xl - lgamma(al))
    high = ok & (x >= a + 1)
    if high.any():
        ah, xh = a[high], x[high]
        b = xh + 1.0 - ah
        c = np.full(ah.shape, 1e300)
        d = 1.0 / b
        h = d.copy()
        for i in range(1, 100_000):
            an = -i * (i - ah)
            b = b + 2.0
            d = an * d + b
            d = 1.0 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            delta = d * c
            h = h * delta
            if np.all(np.abs(delta - 1.0) < 1e-14):
                break
        out[high] = h * np.exp(ah * np.log(xh) - xh - lgamma(ah))
    return np.clip(out, 0.0, 1.0)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    c = np.ones(a.shape)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 100_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            delta = c * d
            h = h * delta
        if np.all(np.abs(delta - 1.0) < 1e-14):
            break
    return h


def beta_cdf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    out = np.where(x >= 1, 1.0, 0.0)
    out = np.where(np.isfinite(a) & np.isfinite(b) & np.isfinite(x), out, np.nan)
    ok = np.isfinite(out) & (x > 0) & (x < 1) & (a > 0) & (b > 0)
    if ok.any():
        ao, bo, xo = a[ok], b[ok], x[ok]
        front = np.exp(
            lgamma(ao + bo) - lgamma(ao) - lgamma(bo) + ao * np.log(xo) + bo * np.log1p(-xo)
        )
        swap = xo >= (ao + 1) / (ao + bo + 2)
        p, q, y = np.where(swap, bo, ao), np.where(swap, ao, bo), np.where(swap, 1 - xo, xo)
        part = front * _beta_fraction(p, q, y) / p
        out = out.copy()
        out[ok] = np.where(swap, 1 - part, part)
    return np.clip(out, 0.0, 1.0)


def chi2_sf_np(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    return gamma_sf(np.asarray(df, float) / 2.0, np.asarray(x, float) / 2.0)


def f_sf_np(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f, d1, d2 = np.asarray(f, float), np.asarray(d1, float), np.asarray(d2, float)
    return beta_cdf(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def t_two_sided_np(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_cdf(df / 2.0, np.full(df.shape, 0.5), df / (df + t * t))


def binomial_sf_np(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X >= k) for X ~ Binomial(n, p)."""
    k, n, p = np.asarray(k, float), np.asarray(n, float), np.asarray(p, float)
    spread = n * p * (1 - p)
    wide = spread > 1e6        # the continued fraction is slow there and the normal exact enough
    inner = np.empty(np.broadcast(k, n, p).shape)
    if wide.any():
        z = (k[wide] - 0.5 - n[wide] * p[wide]) / np.sqrt(spread[wide])
        inner[wide] = 0.5 * np.vectorize(math.erfc, otypes=[float])(z / math.sqrt(2))
    tight = ~wide
    if tight.any():
        inner[tight] = beta_cdf(
            np.maximum(k[tight], 1e-9), np.maximum(n[tight] - k[tight] + 1, 1e-9), np.clip(p[tight], 0, 1)
        )
    return np.where(k <= 0, 1.0, np.where(k > n, 0.0, inner))


def poisson_sf_np(k: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """P(X >= k) for X ~ Poisson(lam)."""
    k, lam = np.asarray(k, float), np.asarray(lam, float)
    inner = 1.0 - gamma_sf(np.maximum(k, 1.0), np.maximum(lam, 1e-300))
    # 1 - Q loses the far tail; the series for the lower gamma keeps it.
    far = (k > lam + 1) & (k >= 1)
    if far.any():
        kf, lf = k[far], np.maximum(lam[far], 1e-300)
        term = np.ones(kf.shape) / kf
        total = term.copy()
        for i in range(1, 10_000):
            term = term * lf / (kf + i)
            total += term
            if np.all(term <= total * 1e-15):
                break
        inner = inner.copy()
        inner[far] = total * np.exp(kf * np.log(lf) - lf - lgamma(kf))
    return np.where(k <= 0, 1.0, np.clip(inner, 0.0, 1.0))


def fisher_exact_np(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Two-sided exact test of each 2x2 table (sum of no more likely tables).

    The hypergeometric mass is summed within 60 standard deviations of its
    mode, beyond which it is below double precision.
    """
    out = np.empty(len(a))
    for i, (w, x, y, z) in enumerate(zip(a, b, c, d, strict=True)):
        w, x, y, z = int(w), int(x), int(y), int(z)
        n, row, col = w + x + y + z, w + x, w + y
        if n == 0:
            out[i] = 1.0
            continue
        lo, hi = max(0, col - (y + z)), min(row, col)
        mean = row * col / n
        sd = math.sqrt(max(mean * (1 - row / n) * (n - col) / max(n - 1, 1), 1.0))
        grid = np.arange(max(lo, int(mean - 60 * sd) - 1), min(hi, int(mean + 60 * sd) + 1) + 1)
        if w < grid[0] or w > grid[-1]:
            out[i] = 0.0
            continue
        base = (math.lgamma(row + 1) + math.lgamma(n - row + 1) + math.lgamma(col + 1)
                + math.lgamma(n - col + 1) - math.lgamma(n + 1))
        logp = base - (lgamma(grid + 1) + lgamma(row - grid + 1) + lgamma(col - grid + 1)
                       + lgamma(n - row - col + grid + 1))
        seen = logp[w - grid[0]]
        out[i] = min(1.0, float(np.exp(logp[logp <= seen + 1e-7 * max(1.0, abs(seen))]).sum()))
    return out
