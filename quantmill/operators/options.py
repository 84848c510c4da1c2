"""Option prices, greeks and probabilities as column expressions.

Columns S, K, T, r, sigma, q. By default the call has no dividend factor and the put
grows by r - q; textbook=True gives the standard formula with dividends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import normal


def dividend_yield(freq: Column, s: Column, dividend: Column) -> Column:
    return F.log(F.try_divide(dividend * freq, s))


def d1(s: Column, k: Column, t: Column, r: Column, sigma: Column, q: Column) -> Column:
    return F.try_divide(F.log(F.try_divide(s, k)) + (r - q + sigma * sigma / 2) * t, sigma * F.sqrt(t))


def d2(s: Column, k: Column, t: Column, r: Column, sigma: Column, q: Column) -> Column:
    return d1(s, k, t, r, sigma, q) - sigma * F.sqrt(t)


def checked(kind: str) -> str:
    if kind.lower() not in ("c", "p"):
        raise ValueError("kind must be c or p")
    return kind.lower()


def price(kind: str, s: Column, k: Column, t: Column, r: Column, sigma: Column, q: Column, *, textbook: bool = False) -> Column:
    a, b, paid = d1(s, k, t, r, sigma, q), d2(s, k, t, r, sigma, q), k * F.exp(-r * t)
    if checked(kind) == "c":
        return (s * F.exp(-q * t) if textbook else s) * normal.cdf(a) - paid * normal.cdf(b)
    return paid * normal.cdf(-b) - s * F.exp((-q if textbook else r - q) * t) * normal.cdf(-a)


def delta(kind: str, s: Column, k: Column, t: Column, r: Column, sigma: Column, q: Column) -> Column:
    up = normal.cdf(d1(s, k, t, r, sigma, q))
    return F.exp(-q * t) * (up if checked(kind) == "c" else up - 1)


def gamma(s: Column, k: Column, t: Column, r: Column, sigma: Column, q: Column) -> Column:
    a = d1(s, k, t, r, sigma, q)
    return F.try_divide(F.exp(-q * t - a * a / 2), s * sigma * F.sqrt(2 * math.pi * t))


def vega(s: Column, k: Column, t: Column, r: Column, sigma: Column, q: Column) -> Column:
    """Per point of volatility."""
    return 0.01 * s * F.exp(-q * t) * F.sqrt(t) * normal.pdf(d1(s, k, t, r, sigma, q))


def implied_volatility(option: Column, s: Column, k: Column) -> Column:
    """Closed-form estimate from the price of the option; null where it has none."""
    twice = 2 * option + k - s
    under = twice * twice - F.try_divide(1.85 * (s + k) * (k - s) * (k - s), math.pi * F.sqrt(s * k))
    return F.when(under >= 0, math.sqrt(2 * math.pi) / (2 * (s + k)) * (twice + F.sqrt(F.when(under >= 0, under))))


def probability_below(spot: Column, strike: Column, window: Column, sigma: Column) -> Column:
    """sigma in per cent a year, window in days."""
    return normal.cdf(F.try_divide(F.log(F.try_divide(strike, spot)), 0.01 * sigma * F.sqrt(window / 365)))


def put_probability(spot: Column, strike: Column, window: Column, sigma: Column) -> Column:
    return F.round(100 * probability_below(spot, strike, window, sigma), 4)


def call_probability(spot: Column, strike: Column, window: Column, sigma: Column) -> Column:
    return F.round(100 * (1 - probability_below(spot, strike, window, sigma)), 4)


def profit_probability(premium: Column, fees: Column, low: Column, high: Column) -> Column:
    return 1 - F.try_divide(premium - fees, high - low)


def risk_premium(premium: Column, probability: Column, width: Column, threshold: Column) -> Column:
    """Whether premium per probability and width is above the threshold."""
    return F.try_divide(premium, probability) * width > threshold
