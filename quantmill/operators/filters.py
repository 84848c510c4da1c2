"""Event filters and side indicators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import ordered_scan
from .volatility import ewm


def cusum_step(state: list, value: float | None, limit: float) -> bool:
    """Symmetric CUSUM on absolute differences; state is [last value, up, down].

    Only the side that fires restarts.
    """
    if value is None:
        return False
    last, state[0] = state[0], value
    if last is None:
        return False
    # added before the last value goes, in the order of the formula: at the limit the last bit decides
    state[1], state[2] = max(0.0, state[1] + value - last), min(0.0, state[2] + value - last)
    if state[1] >= limit:
        state[1] = 0.0
        return True
    if state[2] <= -limit:
        state[2] = 0.0
        return True
    return False


def cusum_events(df: DataFrame, limit: float | str, close: str = "close", *, key: str = "series_id", order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """The rows at which the filter fires.

    limit is a number, or the name of a column whose mean over the series is the limit.
    """
    if isinstance(limit, str):
        means = df.groupBy(key).agg(F.avg(limit).alias("_limit"))
        rows = df.join(means, key)
    elif limit <= 0:
        raise ValueError("limit must be positive")
    else:
        rows = df.withColumn("_limit", F.lit(float(limit)))

    def step(state: list, value: float | None, least: float | None) -> bool:
        return least is not None and cusum_step(state, value, least)

    return ordered_scan(rows, key, order, lambda: [None, 0.0, 0.0], step, [close, "_limit"]).select(df.columns)


def bands(df: DataFrame, window: int = 50, width: float = 0.001, close: str = "close", *, key: str = "series_id", order: Sequence[str] = ("ts", "seq"), block_rows: int | None = None) -> DataFrame:
    """ewm_mean and the bands upper, lower at width times the mean around it."""
    out = ewm(df, close, window, key=key, order=order, mean="ewm_mean", block_rows=block_rows)
    return out.withColumns({"upper": F.col("ewm_mean") * (1 + width), "lower": F.col("ewm_mean") * (1 - width)})


def side(close: Column, upper: Column, lower: Column) -> Column:
    """-1 at or above the upper band, else +1 at or below the lower one, else null."""
    return F.when(close >= upper, -1).when(close <= lower, 1)


def band_side(df: DataFrame, window: int = 100, width: float = 0.001, close: str = "close", *, key: str = "series_id", order: Sequence[str] = ("ts", "seq"), block_rows: int | None = None) -> DataFrame:
    """The rows that touch a band, with their side."""
    out = bands(df, window, width, close, key=key, order=order, block_rows=block_rows)
    return out.withColumn("side", side(F.col(close), F.col("upper"), F.col("lower"))).dropna()
