"""Distribution functions in numpy: normal, t, F, chi-square. Vectorised, to about 1e-10."""

from __future__ import annotations

import math

import numpy as np

_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def normal_sf(z):
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2))


def beta_inc(a, b, x):
    """Regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    a, b, x = (v.astype(float) for v in np.broadcast_arrays(a, b, x))
    shape = x.shape
    a, b, x = a.ravel(), b.ravel(), np.clip(x.ravel(), 0, 1)
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    out = np.where(y <= 0, 0.0, front * h)
    return np.where(flip, 1 - out, out).reshape(shape)


def t_two_sided(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_sf(f, d1, d2):
    f = np.maximum(np.asarray(f, float), 0)
    return 1 - beta_inc(np.asarray(d1) / 2, np.asarray(d2) / 2, d1 * f / (d1 * f + d2))


def chi2_sf(x, df):
    """Upper tail of chi-square by the series for the lower incomplete gamma function, or its continued fraction."""
    x, df = (v.astype(float) for v in np.broadcast_arrays(x, df))
    a, z = df / 2, np.maximum(x / 2, 0)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(a * np.log(z) - z - _lgamma(a))
        term = total = 1 / a
        for k in range(1, 500):
            term = term * z / (a + k)
            total = total + term
        low = front * total
        d, c = 1 / (z + 1 - a), np.full_like(z, 1e300)
        h = d
        for k in range(1, 500):
            num, b = -k * (k - a), z + 2 * k + 1 - a
            d, c = 1 / (num * d + b), b + num / c
            h = h * d * c
        high = front * h
    return np.clip(np.where(z <= 0, 1.0, np.where(z < a + 1, 1 - low, high)), 0, 1)


def normal_quantile(p):
    """Inverse of the normal distribution function, by bisection on normal_sf."""
    p = np.asarray(p, float)
    lo, hi = np.full(p.shape, -40.0), np.full(p.shape, 40.0)
    for _ in range(90):
        mid = (lo + hi) / 2
        below = 1 - normal_sf(mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2
