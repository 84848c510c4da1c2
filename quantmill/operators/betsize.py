"""Bet sizes from probabilities, prices and concurrent positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal
from ..functions.intervals import covering


def active_average(signals: DataFrame, *, key: str = "series_id", block_days: int | None = None) -> DataFrame:
    """At each start or end of a signal: signal = mean of the signals with t0 <= ts < t1 (null t1: for ever), else 0."""
    points = signals.select(key, F.col("t0").alias("ts")).unionAll(signals.where("t1 is not null").select(key, F.col("t1").alias("ts"))).distinct()
    out = covering(points, signals.where("signal is not null"), key, "ts", {"_s": F.col("signal"), "_n": F.lit(1.0)}, closed=False, block_days=block_days)
    return out.select(key, "ts", F.when(F.round("_n") > 0, F.col("_s") / F.col("_n")).otherwise(0.0).alias("signal"))


def discrete(signal: Column, step: float = 0.01) -> Column:
    """Rounded half to even to multiples of step, within -1 and 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.bround(signal / step) * step))


def signal_size(prob: Column, n_classes: int = 2) -> Column:
    """2 Phi(z) - 1 with z = (p - 1/n) / sqrt(p (1 - p))."""
    return 2 * normal.cdf(F.try_divide(prob - 1.0 / n_classes, F.sqrt(prob * (1 - prob)))) - 1


def bet_signal(events: DataFrame, n_classes: int = 2, step: float | None = None, *, key: str = "series_id") -> DataFrame:
    """Average active signals of events with prob, and where they are there pred and side."""
    s = signal_size(F.col("prob"), n_classes)
    for factor in ("pred", "side"):
        if factor in events.columns:
            s = s * F.col(factor)
    out = active_average(events.select(key, "t0", "t1", s.alias("signal")), key=key)
    return out if step is None else out.withColumn("signal", discrete(F.col("signal"), step))


def sigmoid_size(w: Column, x: Column) -> Column:
    return F.try_divide(x, F.sqrt(w + x * x))


def target_position(w: Column, forecast: Column, price: Column, most: Column) -> Column:
    return (sigmoid_size(w, forecast - price) * most).cast("bigint")


def inverse_price(forecast: Column, w: Column, m: Column) -> Column:
    return forecast - m * F.sqrt(w / (1 - m * m))


def _mean_inverse(target: Column, pos: Column, most: Column, price) -> Column:
    """Mean of price(j / most) over j from |pos + sgn| to |target|; null if nothing is to trade."""
    sign = F.when(target >= pos, 1).otherwise(-1)
    first, last = F.abs(pos + sign).cast("bigint"), F.abs(target).cast("bigint")
    total = F.when(last >= first, F.aggregate(F.sequence(first, F.greatest(first, last)), F.lit(0.0), lambda a, j: a + price(j / most))).otherwise(0.0)
    return F.when(target != pos, total / F.abs(target - pos))


def limit_price(target: Column, pos: Column, forecast: Column, w: Column, most: Column) -> Column:
    return _mean_inverse(target, pos, most, lambda m: inverse_price(forecast, w, m))


def width_coefficient(x: Column, m: Column) -> Column:
    return x * x * (F.pow(m, F.lit(-2.0)) - 1)


def dynamic_bet(df: DataFrame, calibration: tuple[float, float] = (10.0, 0.95)) -> DataFrame:
    """Adds w, target and limit from pos, max_pos, price, forecast; calibration: divergence and its size."""
    w = width_coefficient(F.lit(calibration[0]), F.lit(calibration[1]))
    out = df.withColumn("w", w).withColumn("target", target_position(F.col("w"), F.col("forecast"), F.col("price"), F.col("max_pos")))
    return out.withColumn("limit", limit_price(F.col("target"), F.col("pos"), F.col("forecast"), F.col("w"), F.col("max_pos")))


def concurrent_bets(events: DataFrame, *, key: str = "series_id", block_days: int | None = None) -> DataFrame:
    """At each t0: longs and shorts alive (t0 <= ts < t1); events have a side."""
    points = events.select(key, F.col("t0").alias("ts")).distinct()
    side = lambda test: F.when(test, 1.0).otherwise(0.0)
    out = covering(points, events, key, "ts", {"longs": side(F.col("side") > 0), "shorts": side(F.col("side") < 0)}, closed=False, block_days=block_days)
    return out.withColumns({c: F.round(c).cast("bigint") for c in ("longs", "shorts")})


def budget_bets(events: DataFrame, *, key: str = "series_id") -> DataFrame:
    """bet: longs over the most longs, less shorts over the most shorts, of the series."""
    c, whole = concurrent_bets(events, key=key), Window.partitionBy(key)
    part = lambda n: F.coalesce(F.col(n) / F.nullif(F.max(n).over(whole), F.lit(0)), F.lit(0.0))
    return c.withColumn("bet", part("longs") - part("shorts"))


def raw_moments(df: DataFrame, column: str, n: int = 5) -> list[float]:
    return [float(x) for x in df.agg(*(F.avg(F.pow(F.col(column).cast("double"), F.lit(float(i)))) for i in range(1, n + 1))).first()]


def mixture_bets(df: DataFrame, column: str, params: Sequence[float]) -> DataFrame:
    """bet from the mixture distribution of the column; params: mu1, mu2, std1, std2, p1."""
    mu1, mu2, s1, s2, p1 = params
    cdf = lambda x: p1 * normal.cdf((x - mu1) / s1) + (1 - p1) * normal.cdf((x - mu2) / s2)
    at, zero = cdf(F.col(column).cast("double")), cdf(F.lit(0.0))
    return df.withColumn("bet", F.when(F.col(column) >= 0, (at - zero) / (1 - zero)).otherwise((at - zero) / zero))


def mixture_bet_sizes(events: DataFrame, *, key: str = "series_id", **fit) -> DataFrame:
    """bet of longs less shorts by a two-Gaussian mixture fitted to all its values."""
    from .mixture import fit_moments, mean_parameters

    c = concurrent_bets(events, key=key).withColumn("net", F.col("longs") - F.col("shorts"))
    params = mean_parameters(fit_moments(events.sparkSession, raw_moments(c, "net"), **fit))
    return mixture_bets(c, "net", params)


def power_size(w: Column, x: Column) -> Column:
    """sign(x) |x|^w for |x| <= 1; beyond it an error."""
    return F.when(F.abs(x) <= 1, F.signum(x) * F.pow(F.abs(x), w)).otherwise(F.raise_error(F.lit("price divergence must be within -1 and 1")).cast("double"))


def power_target(w: Column, forecast: Column, price: Column, most: Column) -> Column:
    return (power_size(w, forecast - price) * most).cast("bigint")


def power_inverse_price(forecast: Column, w: Column, m: Column) -> Column:
    return forecast - F.signum(m) * F.pow(F.abs(m), 1 / w)


def power_limit_price(target: Column, pos: Column, forecast: Column, w: Column, most: Column) -> Column:
    """Null where nothing is to trade."""
    return _mean_inverse(target, pos, most, lambda m: power_inverse_price(forecast, w, m))


def power_width(x: Column, m: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log(m / F.signum(x)) / F.log(F.abs(x)))


