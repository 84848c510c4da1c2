"""Small numerical kernels: unit-root tests, minimisers."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

#: MacKinnon's (1994) response surface for the constant-only test: p = Phi(polynomial in the statistic),
#: below and above the cut; limits of the statistic (fixed values).
MACKINNON_SMALL, MACKINNON_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
MACKINNON_CUT, MACKINNON_LEAST, MACKINNON_MOST = -1.61, -18.83, 2.74
#: MacKinnon's (2010) critical value at 5 %, constant only: b0 + b1/n + b2/n^2 + b3/n^3 (fixed values).
CRITICAL_5 = (-2.86154, -2.8903, -4.234, -40.04)
#: Quantiles of the KPSS statistic around a trend: p values and statistics (fixed values).
KPSS_P, KPSS_TREND = (0.10, 0.05, 0.025, 0.01), (0.119, 0.146, 0.176, 0.216)


def phi(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, their standard errors and residuals."""
    coef, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ coef
    free = max(len(y) - x.shape[1], 1)
    return coef, np.sqrt(np.maximum(np.diag(np.linalg.pinv(x.T @ x)), 0) * (rest @ rest) / free), rest


def adf(x: np.ndarray, lags: int = 1) -> tuple[float, float, int, float]:
    """Augmented Dickey-Fuller with a constant: statistic, p value, observations, 5 % value."""
    dx = np.diff(x)
    n = len(dx) - lags
    if n < lags + 4:
        return math.nan, math.nan, max(n, 0), math.nan
    columns = [x[lags:-1], *(dx[lags - k : len(dx) - k] for k in range(1, lags + 1)), np.ones(n)]
    coef, error, _ = ols(np.column_stack(columns), dx[lags:])
    if error[0] == 0:
        return math.nan, math.nan, n, math.nan
    stat = float(coef[0] / error[0])
    if stat > MACKINNON_MOST:
        p = 1.0
    elif stat < MACKINNON_LEAST:
        p = 0.0
    else:
        p = phi(sum(c * stat**i for i, c in enumerate(MACKINNON_SMALL if stat <= MACKINNON_CUT else MACKINNON_LARGE)))
    return stat, p, n, sum(c / n**i for i, c in enumerate(CRITICAL_5))


def kpss(x: np.ndarray) -> tuple[float, float]:
    """KPSS around a trend with automatic bandwidth: statistic and p value (within 0.01 to 0.1)."""
    n = len(x)
    _, _, e = ols(np.column_stack([np.ones(n), np.arange(n)]), x)
    most = int(n ** (2 / 9))
    s0 = e @ e / n
    s1 = 0.0
    for i in range(1, most + 1):
        c = 2 * (e[i:] @ e[:-i]) / n
        s0, s1 = s0 + c, s1 + i * c
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)) if s0 > 0 else 0, n - 1)
    long = e @ e / n + 2 * sum((1 - i / (lags + 1)) * (e[i:] @ e[:-i]) / n for i in range(1, lags + 1))
    stat = float((np.cumsum(e) ** 2).sum() / n**2 / long) if long > 0 else math.nan
    return stat, float(np.interp(stat, KPSS_TREND, KPSS_P))


def shapiro(x: np.ndarray) -> tuple[float, float]:
    """Shapiro-Wilk by Royston's (1995) approximation: W and p value, for 12 values or more (p was fitted on up to 5000)."""
    from statistics import NormalDist

    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 12 or x[0] == x[-1]:
        return math.nan, math.nan
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, u = m @ m, 1 / math.sqrt(n)
    c = m / math.sqrt(mm)
    a_n = c[-1] + 0.221157 * u - 0.147981 * u**2 - 2.071190 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
    a_1 = c[-2] + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
    f = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a_n**2 - 2 * a_1**2)
    a = m / math.sqrt(f)
    a[0], a[1], a[-2], a[-1] = -a_n, -a_1, a_1, a_n
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    log = math.log(n)
    mu = 0.0038915 * log**3 - 0.083751 * log**2 - 0.31082 * log - 1.5861
    sigma = math.exp(0.0030302 * log**2 - 0.082676 * log - 0.4803)
    return w, 1 - phi((math.log(max(1 - w, 1e-300)) - mu) / sigma)


def golden(f: Callable[[float], float], a: float, b: float, tol: float = 1e-9, maximum: bool = False) -> tuple[float, float]:
    """The place and value of the extremum of a unimodal function."""
    sign = -1 if maximum else 1
    ratio = (math.sqrt(5) - 1) / 2
    x1, x2 = b - ratio * (b - a), a + ratio * (b - a)
    f1, f2 = sign * f(x1), sign * f(x2)
    while b - a > tol:
        if f1 > f2:
            a, x1, f1 = x1, x2, f2
            x2 = a + ratio * (b - a)
            f2 = sign * f(x2)
        else:
            b, x2, f2 = x2, x1, f1
            x1 = b - ratio * (b - a)
            f1 = sign * f(x1)
    return (x1, sign * f1) if f1 < f2 else (x2, sign * f2)


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, steps: int = 400, tol: float = 1e-9) -> tuple[np.ndarray, float]:
    """A minimum near the start by the downhill simplex."""
    n = len(start)
    simplex = [np.array(start, float)] + [np.array(start, float) + (0.1 * abs(start[i]) + 0.01) * np.eye(n)[i] for i in range(n)]
    values = [f(p) for p in simplex]
    for _ in range(steps):
        order = np.argsort(values)
        simplex, values = [simplex[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < tol * (abs(values[0]) + tol):
            break
        middle = np.mean(simplex[:-1], axis=0)
        mirror = middle + (middle - simplex[-1])
        v = f(mirror)
        if v < values[0]:
            far = middle + 2 * (middle - simplex[-1])
            u = f(far)
            simplex[-1], values[-1] = (far, u) if u < v else (mirror, v)
        elif v < values[-2]:
            simplex[-1], values[-1] = mirror, v
        else:
            near = middle + 0.5 * (simplex[-1] - middle)
            u = f(near)
            if u < values[-1]:
                simplex[-1], values[-1] = near, u
            else:
                simplex = [simplex[0]] + [simplex[0] + 0.5 * (p - simplex[0]) for p in simplex[1:]]
                values = [values[0]] + [f(p) for p in simplex[1:]]
    best = int(np.argmin(values))
    return simplex[best], values[best]
