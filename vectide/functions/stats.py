"""Student-t tail probabilities as a vectorised column function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _incomplete_beta(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (x < (a+1)/(a+b+2))."""
    tiny = 1e-300
    front = np.array([math.lgamma(v + b) - math.lgamma(v) - math.lgamma(b) for v in a])
    with np.errstate(divide="ignore"):
        front = np.exp(front + a * np.log(x) + b * np.log1p(-x)) / a
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    value = d.copy()
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            value = value * c * d
        if np.all(np.abs(c * d - 1.0) < 1e-15):
            break
    return front * value


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) for Student's t with `df` degrees of freedom."""
    t, df = np.abs(np.asarray(t, dtype=float)), np.asarray(df, dtype=float)
    out = np.full(t.shape, np.nan)
    out[np.isinf(t)] = 0.0
    ok = np.isfinite(t) & (df > 0)
    t, df = t[ok], df[ok]
    x = df / (df + t * t)
    a = df / 2.0
    p = np.empty_like(x)
    direct = x < (a + 1.0) / (a + 2.5)
    if direct.any():
        p[direct] = _incomplete_beta(a[direct], 0.5, x[direct])
    rest = ~direct
    if rest.any():
        # the mirrored argument: I_x(a, 1/2) = 1 - I_{1-x}(1/2, a)
        for df_value in np.unique(df[rest]):
            same = rest & (df == df_value)
            half = np.full(int(same.sum()), 0.5)
            p[same] = 1.0 - _incomplete_beta(half, df_value / 2.0, 1.0 - x[same])
    out[ok] = p
    return out


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(dtype=float), df.to_numpy(dtype=float)))
