"""The normal distribution as expressions.

Neither Spark nor most SQL engines have erf. The distribution function uses the rational
form of Hart (1968) as given by West (2005), with an error near 2e-16 for |x| <= 7; the
same text works as a Spark SQL and as an ANSI SQL expression.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Hart's approximation, highest power first (fixed values).
NUMERATOR = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
DENOMINATOR = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _horner_sql(coefficients: tuple[float, ...], x: str) -> str:
    out = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return out


def cdf_sql(x: str) -> str:
    """SQL text of the distribution function of a DOUBLE expression."""
    a = f"least(abs({x}), CAST(7 AS DOUBLE))"
    tail = f"exp(-{a} * {a} / 2) * {_horner_sql(NUMERATOR, a)} / {_horner_sql(DENOMINATOR, a)}"
    return f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) > 0 THEN 1 - {tail} ELSE {tail} END)"


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def cdf(x: Column) -> Column:
    """The distribution function."""
    a = F.least(F.abs(x), F.lit(7.0))
    tail = F.exp(-a * a / 2) * _horner(NUMERATOR, a) / _horner(DENOMINATOR, a)
    return F.when(x > 0, 1 - tail).when(x <= 0, tail)


def pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / 2.5066282746310002


def ppf(p: float) -> float:
    """The quantile of a number known on the driver."""
    return NormalDist().inv_cdf(p)
