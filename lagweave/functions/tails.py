"""Tail probabilities of the normal, chi-square, t and F distributions.

These run as Arrow UDFs: they are applied to result tables (one row per test), never to raw rows, and the
target image has no SciPy. Each batch is evaluated with vectorized continued fractions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = 400

# Lanczos coefficients (g = 7, n = 9) for the log-gamma function.
LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]


def _lgamma(z: np.ndarray) -> np.ndarray:
    shift = np.where(z < 1, np.log(np.maximum(z, 1e-300)), 0.0)
    x = np.where(z < 1, z + 1, z) - 1
    total = LANCZOS[0] + sum(c / (x + i) for i, c in enumerate(LANCZOS[1:], start=1))
    t = x + 7.5
    return 0.5 * np.log(2 * np.pi) + (x + 0.5) * np.log(t) - t + np.log(total) - shift


def _gamma_q(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Upper regularized incomplete gamma."""
    y = np.maximum(x, 1e-300)
    front = np.exp(a * np.log(y) - y - _lgamma(a))
    low = y < a + 1
    xs = np.where(low, y, 0.5 * a)
    term, total = 1 / a, 1 / a
    for k in range(1, TERMS):
        term = term * xs / (a + k)
        total = total + term
    xl = np.where(low, a + 2, y)
    tail = xl + 2 * TERMS + 1 - a
    for k in range(TERMS, 0, -1):
        tail = xl + 2 * k - 1 - a - k * (k - a) / tail
    q = np.where(low, 1 - front * total, front / tail)
    return np.where(x <= 0, 1.0, np.clip(q, 0.0, 1.0))


def _beta_i(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularized incomplete beta; the branch with the fast fraction is chosen per element."""
    y = np.clip(x, 1e-300, 1 - 1e-16)
    swap = y > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - y, y)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tail = np.ones_like(z)
    for m in range(TERMS, 0, -1):
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        tail = 1 + even / (1 + odd / tail)
    value = front / (1 - (p + q) * z / (p + 1) / tail)
    value = np.where(swap, 1 - value, value)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.clip(value, 0.0, 1.0)))


def _masked(fn, *cols: pd.Series) -> pd.Series:
    arrays = [c.to_numpy(dtype=float) for c in cols]
    ok = np.all([np.isfinite(a) for a in arrays], axis=0)
    out = np.full(len(cols[0]), np.nan)
    if ok.any():
        with np.errstate(all="ignore"):
            out[ok] = fn(*[a[ok] for a in arrays])
    return pd.Series(out).replace({np.nan: None}).astype("Float64") if not ok.all() else pd.Series(out)


def _chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return _masked(lambda v, d: _gamma_q(d / 2, v / 2), x, df)


def _norm(z: pd.Series) -> pd.Series:
    return _masked(lambda v: _gamma_q(np.full_like(v, 0.5), v * v / 2), z)


def _student(t: pd.Series, df: pd.Series) -> pd.Series:
    return _masked(lambda v, d: _beta_i(d / 2, np.full_like(d, 0.5), d / (d + v * v)), t, df)


def _fisher(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _masked(lambda v, n, d: _beta_i(d / 2, n / 2, d / (d + n * v)), f, d1, d2)


def _doubles(*cols: Column) -> list[Column]:
    return [c.cast("double") for c in cols]


def p_chi2(x: Column, df: Column) -> Column:
    return F.pandas_udf(_chi2, "double")(*_doubles(x, df))


def p_norm(z: Column) -> Column:
    """Two-sided normal tail."""
    return F.pandas_udf(_norm, "double")(*_doubles(z))


def p_t(t: Column, df: Column) -> Column:
    """Two-sided Student tail."""
    return F.pandas_udf(_student, "double")(*_doubles(t, df))


def p_f(f: Column, d1: Column, d2: Column) -> Column:
    """Upper F tail."""
    return F.pandas_udf(_fisher, "double")(*_doubles(f, d1, d2))
