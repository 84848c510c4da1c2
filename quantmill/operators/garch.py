"""GARCH(1,1) with constant mean and normal errors, and rolling deviations."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import nelder_mead
from ..functions.windows import divided, logarithm, ordered, rolling
from .reports import _per_series


def variances(params: Sequence[float], e: np.ndarray) -> np.ndarray:
    omega, a, b = params
    out, now = np.empty(len(e)), float(e @ e / len(e))
    for i, x in enumerate(e):
        out[i] = now
        now = omega + a * x * x + b * now
    return out


def logistic(x: float) -> float:
    """1 / (1 + exp(-x)), without overflow at either end."""
    e = math.exp(-abs(x))
    return 1 / (1 + e) if x >= 0 else e / (1 + e)


def fit(x: np.ndarray) -> tuple[float, float, float, float, float, float]:
    """mu, omega, alpha, beta, log likelihood and the deviation forecast; x in per cent. Returns that are not finite are left out."""
    x = x[np.isfinite(x)]
    v0 = float(x.var()) if len(x) else 0.0
    if len(x) < 20 or v0 == 0:
        return (math.nan,) * 6

    def unpack(p: np.ndarray) -> tuple[float, float, float, float]:
        persist, share = logistic(p[2]) * 0.9999, logistic(p[3])
        return float(p[0]), math.exp(min(p[1], 50.0)), persist * share, persist * (1 - share)

    def loss(p: np.ndarray) -> float:
        mu, omega, a, b = unpack(p)
        e = x - mu
        h = np.maximum(variances((omega, a, b), e), 1e-12)
        return 0.5 * float((np.log(2 * math.pi * h) + e * e / h).sum())

    start = np.array([x.mean(), math.log(v0 * 0.1), math.log(0.9 / 0.1), math.log(0.1 / 0.9)])
    best, least = nelder_mead(loss, start)
    mu, omega, a, b = unpack(best)
    e = x - mu
    h = variances((omega, a, b), e)
    return mu, omega, a, b, -least, math.sqrt(0.01 * (omega + a * e[-1] ** 2 + b * h[-1]))


def garch(returns: DataFrame, column: str = "ret", *, key: str = "series_id", order: Sequence[str] = ("ts",)) -> DataFrame:
    """Parameters and forecast of each series of returns (times 100 before fitting)."""
    names = ("mu", "omega", "alpha", "beta", "log_likelihood", "forecast")
    return _per_series(returns, key, order, column, dict.fromkeys(names, "double"), lambda x: fit(x * 100))


def returns_of(df: DataFrame, column: str = "close", *, log: bool = False, key: str = "series_id", order: Sequence[str] = ("ts",)) -> DataFrame:
    before = F.lag(column).over(ordered(key, *order))
    ratio = divided(F.col(column), before)
    ret = logarithm(ratio) if log else ratio - 1
    return df.withColumn("ret", ret).where("ret is not null")


def rolling_deviation(returns: DataFrame, window: int, period: str = "trading", column: str = "ret", *, key: str = "series_id", order: Sequence[str] = ("ts",), name: str = "deviation") -> DataFrame:
    """Yearly deviation over a window: times the root of 252 (trading) or 365 (calendar) days."""
    if period not in ("trading", "calendar"):
        raise ValueError("period must be trading or calendar")
    return returns.withColumn(name, rolling(F.stddev_samp, F.col(column), ordered(key, *order), window) * math.sqrt(252 if period == "trading" else 365))
