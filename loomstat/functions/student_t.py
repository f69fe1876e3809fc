"""Student's t-distribution on columns, a batch of rows at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomstat.functions.text import _c

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(40)
_LIFT = 64
# rows integrated together; each takes 40 numbers per panel
_ROWS = 4096


def _half_gamma_ratio(a: np.ndarray) -> np.ndarray:
    """Gamma(a + 1/2) / Gamma(a): the series at a + 64, brought down by the recurrence."""
    high = a + _LIFT
    series = np.sqrt(high) * np.exp(-1 / (8 * high) + 1 / (192 * high**3) - 1 / (640 * high**5))
    steps = a[:, None] + np.arange(_LIFT)
    return series * np.exp(-np.log1p(0.5 / steps).sum(axis=1))


def _tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t) for t >= 0, by the angle form: a cosine power integrated from atan(t / sqrt(df))."""
    root = np.sqrt(df)
    left = np.arctan(t / root)
    # panels double in width, starting at the scale on which the integrand falls
    step = 0.5 / np.maximum(np.maximum(root, root * t), 1.0)
    area = np.zeros(len(t))
    while (left < np.pi / 2).any():
        right = np.minimum(left + step, np.pi / 2)
        half = ((right - left) / 2)[:, None]
        u = (left + right)[:, None] / 2 + half * _NODES
        with np.errstate(divide="ignore", under="ignore"):
            # the floor is the logarithm at the last number below the right angle
            log_cos = 0.5 * np.maximum(np.log1p(-np.sin(u) ** 2), -80)
        with np.errstate(under="ignore"):
            height = np.exp((df[:, None] - 1) * log_cos)
        area += (half * _WEIGHTS * height).sum(axis=1)
        left, step = right, step * 2
    return np.minimum(area * _half_gamma_ratio(df / 2) / np.sqrt(np.pi), 1.0)


def _in_parts(function, *columns: np.ndarray) -> np.ndarray:
    n = len(columns[0])
    parts = [function(*(c[i : i + _ROWS] for c in columns)) for i in range(0, n, _ROWS)]
    return np.concatenate(parts) if parts else np.empty(0)


def upper_tails(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t); NaN for df that is not positive."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    out = np.full(t.shape, np.nan)
    ok = (df > 0) & np.isfinite(df) & ~np.isnan(t)
    tail = _in_parts(_tail, np.abs(t[ok]), df[ok])
    out[ok] = np.where(t[ok] < 0, 1.0 - tail, tail)
    return out


def _root(tail: np.ndarray, df: np.ndarray) -> np.ndarray:
    """t >= 0 with P(T > t) = tail, by Newton's method from 0.

    The tail is convex there, so that the steps rise to the root and never pass it.
    """
    t = np.zeros(len(tail))
    scale = _half_gamma_ratio(df / 2) / np.sqrt(np.pi * df)
    open_ = np.arange(len(t))[tail < 0.5]
    while len(open_):
        x, n = t[open_], df[open_]
        density = scale[open_] * np.exp(-(n + 1) / 2 * np.log1p(x * x / n))
        step = (_tail(x, n) - tail[open_]) / density
        going = step > 2e-15 * np.maximum(x, 1e-300)
        t[open_] = np.where(going, x + step, x)
        open_ = open_[going & np.isfinite(step)]
    return t


def quantiles(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    """t with P(T <= t) = p, once per different pair; NaN for df < 1 or p outside (0, 1)."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    pairs, back = np.unique(np.stack([p, df], axis=1), axis=0, return_inverse=True)
    p, df = pairs[:, 0], pairs[:, 1]
    out = np.full(len(p), np.nan)
    ok = (df >= 1) & np.isfinite(df) & (p > 0) & (p < 1)
    root = _in_parts(_root, np.minimum(p[ok], 1 - p[ok]), df[ok])
    out[ok] = np.where(p[ok] < 0.5, -root, root)
    return out[back.ravel()]


def upper_tail(t: float, df: float) -> float:
    return float(upper_tails(np.array([t]), np.array([df]))[0])


def quantile(p: float, df: float) -> float:
    return float(quantiles(np.array([p]), np.array([df]))[0])


@F.pandas_udf(DoubleType())
def _sf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(upper_tails(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def _ppf(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(quantiles(p.to_numpy(float), df.to_numpy(float)))


def t_sf(t: Column | str, df: Column | str) -> Column:
    """Upper tail P(T > t)."""
    return F.nanvl(_sf(_c(t).cast("double"), _c(df).cast("double")), F.lit(None).cast("double"))


def t_quantile(p: Column | float, df: Column | str) -> Column:
    """Quantile; NULL for df < 1 or p outside (0, 1)."""
    p = F.lit(float(p)) if isinstance(p, (int, float)) else p
    return F.nanvl(_ppf(p.cast("double"), _c(df).cast("double")), F.lit(None).cast("double"))
