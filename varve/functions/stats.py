"""Distribution tails and hyper-parameters that Spark lacks, as vectorised helpers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after lifting the argument above 10."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        shift = shift - np.where(low, np.log(np.where(low, x, 1.0)), 0.0)
        x = np.where(low, x + 1, x)
    i = 1 / x
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + i / 12 - i**3 / 360 + i**5 / 1260 - i**7 / 1680


def beta_tail(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 300) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0.0, 1.0))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    value = np.where(z <= 0, 0.0, front * h)
    return np.where(flip, 1 - value, value)


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| >= |t|) of Student's t; a df of infinity gives the normal tail. Null stays null."""
    x, n = t.to_numpy(float), np.minimum(df.to_numpy(float), 1e7)
    with np.errstate(invalid="ignore", divide="ignore"):
        p = beta_tail(n / 2, np.full_like(n, 0.5), np.where(np.isinf(x), 0.0, n / (n + x * x)))
    return pd.Series(p).where(~(np.isnan(x) | np.isnan(n)), None)


@F.pandas_udf(T.DoubleType())
def f_upper(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """P(F >= f) of Fisher's F."""
    x, a, b = f.to_numpy(float), df1.to_numpy(float), np.minimum(df2.to_numpy(float), 1e7)
    with np.errstate(invalid="ignore", divide="ignore"):
        p = beta_tail(b / 2, a / 2, b / (b + a * np.maximum(x, 0)))
    return pd.Series(p).where(~np.isnan(x), None)


def digamma(x: np.ndarray | float) -> np.ndarray:
    x, out = np.asarray(x, float), 0.0
    for _ in range(8):
        low = x < 8
        out = out - np.where(low, 1 / x, 0.0)
        x = np.where(low, x + 1, x)
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i / 252))


def trigamma(x: np.ndarray | float) -> np.ndarray:
    x, out = np.asarray(x, float), 0.0
    for _ in range(8):
        low = x < 8
        out = out + np.where(low, 1 / (x * x), 0.0)
        x = np.where(low, x + 1, x)
    i = 1 / (x * x)
    return out + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i / 42))


def trigamma_inverse(y: float) -> float:
    """x with trigamma(x) = y, by Newton's rule on the reciprocal."""
    if y > 1e7:
        return 1 / np.sqrt(y)
    if y < 1e-6:
        return 1 / y
    x = 0.5 + 1 / y
    for _ in range(50):
        tri = float(trigamma(x))
        slope = float(trigamma(x + 1e-5) - trigamma(x - 1e-5)) / 2e-5
        step = tri * (1 - tri / y) / slope
        x += step
        if abs(step / x) < 1e-10:
            break
    return x


def log_variance_offset(df: Column) -> Column:
    """E[ln s2 - ln sigma2] = digamma(df/2) - ln(df/2), as an expression for df of at least 1."""
    h = df / 2
    lifted = h + 6
    fall = sum((1 / (h + i) for i in range(6)), F.lit(0.0))
    i2 = 1 / (lifted * lifted)
    return F.ln(lifted) - 0.5 / lifted - i2 * (F.lit(1 / 12) - i2 * (F.lit(1 / 120) - i2 / 252)) - fall - F.ln(h)
