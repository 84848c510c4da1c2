"""Fractional differences, futures rolls and PCA risk weights."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.linalg import adf
from ..functions.ranks import ranked
from ..functions.tables import written
from ..functions.windows import forward_fill, nan_to_null, ordered


def weights(d: float, size: int) -> list[float]:
    """Weights of the fractional difference of order d, of the latest value first."""
    out = [1.0]
    for k in range(1, size):
        out.append(-out[-1] * (d - k + 1) / k)
    return out


def weights_ffd(d: float, threshold: float = 0.01) -> list[float]:
    """Weights down to the first whose absolute value is below the threshold."""
    out, k = [1.0], 1
    while True:
        w = -out[-1] * (d - k + 1) / k
        if abs(w) < threshold:
            return out
        out.append(w)
        k += 1


def frac_diff_ffd(df: DataFrame, d: float, threshold: float = 0.01, column: str = "close", *, key: str = "series_id", order: Sequence[str] = ("ts",), name: str = "frac_diff") -> DataFrame:
    """Fixed-width fractional difference: one window expression, null in the first width - 1 rows.

    Gaps are filled forward; rows whose own value is null stay null.
    """
    w = ordered(key, *order)
    ws = weights_ffd(d, threshold)
    out = df.withColumn("_x", forward_fill(F.col(column), w))
    frame = w.rowsBetween(-(len(ws) - 1), 0)
    values = F.collect_list("_x").over(frame)
    dot = F.aggregate(F.zip_with(values, F.array(*map(F.lit, reversed(ws))), lambda x, c: x * c), F.lit(0.0), lambda a, x: a + x)
    return out.withColumn(name, F.when((F.size(values) == len(ws)) & F.col(column).isNotNull(), dot)).drop("_x")


def _grouped(df: DataFrame, key: str, order: Sequence[str], run, more: list[T.StructField]) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return run(pdf.sort_values(list(order), kind="stable"))

    return df.groupBy(key).applyInPandas(one, T.StructType([*df.schema.fields, *more]))


def expanding_diff(x: np.ndarray, d: float, threshold: float) -> np.ndarray:
    """Fractional difference over all values so far; NaN until the weights left out are few."""
    n = len(x)
    if not n:
        return x
    w = np.array(weights(d, n))
    share = np.cumsum(np.abs(w[::-1]))
    skip = int((share / share[-1] > threshold).sum())
    full = np.convolve(x, w)[:n] if n < 4096 else np.fft.irfft(np.fft.rfft(x, 2 * n) * np.fft.rfft(w, 2 * n), 2 * n)[:n]
    full[: min(skip, n)] = np.nan
    return full


def _weights_from(first: float, k: int, d: float, size: int) -> np.ndarray:
    """Weights k, k + 1 ... of order d, so many, from weight k."""
    steps = np.arange(k + 1, k + size)
    return np.concatenate([[first], first * np.cumprod(-(d - steps + 1) / steps)])[:size]


def _weight_blocks(d: float, n: int, size: int) -> tuple[list[float], list[float]]:
    """The first weight and the sum of the absolute weights of each block of so many, up to weight n."""
    firsts, sums, first = [], [], 1.0
    for k in range(0, n, size):
        w = _weights_from(first, k, d, size + 1)
        firsts.append(first)
        sums.append(float(np.abs(w[:size]).sum()))
        first = float(w[-1])
    return firsts, sums


def _left_out(d: float, n: int, threshold: float, chunk: int = 1 << 20, known: tuple[list[float], list[float]] | None = None) -> int:
    """Rows of a series of n whose left-out weights have more than a share of all; holds a chunk of weights at a time.

    known: the blocks of weights of so many, as far as n or farther.
    """
    firsts, sums = known or _weight_blocks(d, n, chunk)
    chunks = -(-n // chunk)

    def sizes(c: int) -> np.ndarray:
        return np.abs(_weights_from(firsts[c], c * chunk, d, min(chunk, n - c * chunk)))

    sums = [*sums[: chunks - 1], float(sizes(chunks - 1).sum())]
    total, tail = sum(sums), 0.0
    for c in range(chunks - 1, -1, -1):  # from the last weight on
        if tail + sums[c] > threshold * total:
            place = int(np.searchsorted(tail + np.cumsum(sizes(c)[::-1]), threshold * total, side="right"))
            return min(n, (c + 1) * chunk) - place
        tail += sums[c]
    return 0


def _filled(x: np.ndarray, before: float = np.nan) -> np.ndarray:
    """Gaps (NaN) take the value before them, the first ones that of `before`."""
    at = np.maximum.accumulate(np.where(np.isnan(x), -1, np.arange(len(x))))
    return np.where(at >= 0, x[at], before)


#: Frequencies times blocks of a series that one task multiplies at a time.
PRODUCTS = 1 << 18


def _frac_diff_in_blocks(df: DataFrame, d: float, threshold: float, column: str, key: str, order: Sequence[str], name: str, size: int) -> DataFrame:
    """Overlap-save convolution by blocks of time: a block of the result is the sum of products of all blocks up to it.

    The spectra of a series' blocks and of the blocks of weights are dealt out by bands of frequencies. In a band
    these sums are a convolution along the blocks, done by a Fourier transform in its turn, so that rows and bytes grow
    with the series and work with its logarithm besides. A task holds `size` rows or PRODUCTS complex numbers, never the series.
    A series of up to `size` rows is one block, without spectra.
    """
    own = df.columns
    placed = ranked(df.withColumn("_v", nan_to_null(F.col(column).cast("double"))), key, order, "_t").withColumn("_i", F.floor(F.col("_t") / size).cast("int"))
    place = F.when(F.col("_v").isNotNull(), F.col("_t"))
    parts = written(placed.groupBy(F.col(key).alias("_k"), "_i").agg(F.count("*").alias("_rows"), F.min(place).alias("_first"), F.max_by("_v", place).alias("_last")), "parts")
    series = parts.groupBy("_k").agg(F.sum("_rows").alias("_n"), F.min("_first").alias("_lead"), F.count("*").cast("int").alias("_blocks")).where("_blocks > 1 and _lead is not null")
    longest = series.agg(F.max("_n")).first()[0] or 0
    known = df.sparkSession.sparkContext.broadcast(_weight_blocks(d, longest, size))

    def skipped(batches):
        for batch in batches:
            lengths = zip(batch.column("_n").to_pylist(), batch.column("_lead").to_pylist(), strict=True)
            yield batch.append_column("_from", pa.array([lead + _left_out(d, n - lead, threshold, size, known.value) for n, lead in lengths], pa.int64()))

    skips = series.mapInArrow(skipped, T.StructType([*series.schema.fields, T.StructField("_from", T.LongType())]))
    long = F.broadcast(skips.select(F.col("_k").alias("_l"), "_from"))
    earlier = Window.partitionBy("_k").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    begun = parts.select("_k", "_i", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    begun = begun.join(F.broadcast(series.select(F.col("_k").alias("_l"), "_blocks")), F.col("_k").eqNullSafe(F.col("_l"))).select("_k", "_i", "_before", F.greatest(F.lit(1), F.floor(F.lit(PRODUCTS) / F.col("_blocks"))).cast("int").alias("_width"))

    def values(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows in their block; its values by place."""
        at = table.column("_t").to_numpy() % size
        x = np.full(table.num_rows, np.nan)
        x[at] = table.column("_v").to_numpy()
        return at, x

    def spectra(rows: pa.Table, start: pa.Table) -> pa.Table:
        (i,), (before,), (width,) = (start.column(c).to_pylist() for c in ("_i", "_before", "_width"))
        x = _filled(values(rows)[1], before or 0.0)
        w = np.zeros(2 * size)
        w[:size] = _weights_from(known.value[0][i], i * size, d, size)
        if i:
            w[size + 1 :] = _weights_from(known.value[0][i - 1], (i - 1) * size, d, size)[1:]
        x, w = np.fft.rfft(x, 2 * size), np.fft.rfft(w)
        cuts = range(0, size + 1, width)
        first = [0] * len(cuts)
        columns = [start.column("_k").take(first), pa.array(range(len(cuts)), pa.int32()), start.column("_i").take(first), *(pa.array([f[c : c + width].tobytes() for c in cuts], pa.binary()) for f in (x, w))]
        return pa.table(columns, names=["_k", "_band", "_i", "_x", "_w"])

    def along(table: pa.Table) -> pa.Table:
        table = table.sort_by("_i")
        n = 2 * table.num_rows
        x, w = (np.fft.fft(np.stack([np.frombuffer(f, np.complex128) for f in table.column(c).to_pylist()]), n, axis=0) for c in ("_x", "_w"))
        x *= w
        total = np.fft.ifft(x, axis=0)[: table.num_rows]
        return pa.table([table.column("_k"), table.column("_band"), table.column("_i"), pa.array([row.tobytes() for row in total], pa.binary())], names=["_k", "_band", "_i", "_sum"])

    def finish(rows: pa.Table, bands: pa.Table) -> pa.Table:
        at, x = values(rows)
        gaps = np.isnan(x)
        if bands.num_rows:
            bands = bands.sort_by("_band")
            y = np.fft.irfft(np.frombuffer(b"".join(bands.column("_sum").to_pylist()), np.complex128), 2 * size)[at]
            y[rows.column("_t").to_numpy() < rows.column("_from")[0].as_py()] = np.nan
        else:  # a series of one block, or without values
            x = _filled(x)
            y, there = np.full(len(x), np.nan), ~np.isnan(x)
            y[there] = expanding_diff(x[there], d, threshold)
            y = y[at]
        y[gaps[at]] = np.nan
        return rows.select(own).append_column(name, pa.array(y, from_pandas=True))

    places = [T.StructField("_k", df.schema[key].dataType), T.StructField("_band", T.IntegerType()), T.StructField("_i", T.IntegerType())]
    banded, summed = (T.StructType([*places, *(T.StructField(c, T.BinaryType()) for c in names)]) for names in (("_x", "_w"), ("_sum",)))
    result = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    marked = placed.join(long, F.col(key).eqNullSafe(F.col("_l")), "left").drop("_l")
    cut = marked.where("_from is not null").select(F.col(key).alias("_k"), "_i", "_t", "_v").groupBy("_k", "_i").cogroup(begun.groupBy("_k", "_i")).applyInArrow(spectra, banded)
    sums = cut.groupBy("_k", "_band").applyInArrow(along, summed)
    return marked.groupBy(key, "_i").cogroup(sums.groupBy("_k", "_i")).applyInArrow(finish, result)


def frac_diff(df: DataFrame, d: float, threshold: float = 0.01, column: str = "close", *, key: str = "series_id", order: Sequence[str] = ("ts",), name: str = "frac_diff", block_rows: int | None = None) -> DataFrame:
    """Expanding-window fractional difference by series.

    A series must fit a task unless block_rows is given: then it is cut into blocks of so many rows.
    """
    if block_rows is not None:
        return _frac_diff_in_blocks(df, d, threshold, column, key, order, name, block_rows)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[column].astype(float).ffill()
        at = x.notna().to_numpy()
        out = np.full(len(x), np.nan)
        out[at] = expanding_diff(x.to_numpy()[at], d, threshold)
        out[pdf[column].isna().to_numpy()] = np.nan
        return pdf.assign(**{name: out})

    return _grouped(df, key, order, run, [T.StructField(name, T.DoubleType())]).withColumn(name, F.when(~F.isnan(name), F.col(name)))


def daily_last(df: DataFrame, column: str = "close", *, key: str = "series_id", ts: str = "ts") -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(key, F.date_trunc("day", ts).cast("timestamp_ntz").alias("ts")).agg(F.max_by(column, ts).alias(column))


def order_table(df: DataFrame, orders: Sequence[float], threshold: float = 0.01, column: str = "close", *, key: str = "series_id", log: bool = False) -> DataFrame:
    """For each series and order d: adf_stat, p_value, lags, n_obs, critical_95, corr with the series.

    The grid of orders is dealt out with the series, so that both are parallel.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for d, part in pdf.groupby("d"):
            x = part.sort_values("ts")[column].to_numpy(float)
            x = np.log(x) if log else x
            w = np.array(weights_ffd(d, threshold))
            diff = np.convolve(x, w)[len(w) - 1 : len(x)] if len(x) >= len(w) else np.zeros(0)
            stat, p, n, critical = adf(diff) if len(diff) > 5 else (np.nan, np.nan, len(diff), np.nan)
            corr = np.corrcoef(x[len(w) - 1 :], diff)[0, 1] if len(diff) > 2 and diff.std() > 0 and x[len(w) - 1 :].std() > 0 else np.nan
            rows.append((pdf[key].iloc[0], d, stat, p, 1, n, critical, corr))
        return pd.DataFrame(rows, columns=[key, "d", "adf_stat", "p_value", "lags", "n_obs", "critical_95", "corr"])

    grid = daily_last(df, column, key=key).withColumn("d", F.explode(F.array(*map(F.lit, map(float, orders)))))
    schema = T.StructType([df.schema[key], *(T.StructField(n, T.DoubleType()) for n in ("d", "adf_stat", "p_value")), T.StructField("lags", T.LongType()), T.StructField("n_obs", T.LongType()), T.StructField("critical_95", T.DoubleType()), T.StructField("corr", T.DoubleType())])
    return grid.groupBy(key, "d").applyInPandas(run, schema)


def min_order(df: DataFrame, threshold: float = 0.01, p_value: float = 0.05, num: int = 100, column: str = "close", *, key: str = "series_id", log: bool = False, max_d: float = 1.0) -> DataFrame:
    """The least order whose difference passes the unit-root test (null if none does)."""
    table = order_table(df, np.linspace(0, max_d, num).tolist(), threshold, column, key=key, log=log)
    return table.groupBy(key).agg(F.min(F.when(F.col("p_value") <= p_value, F.col("d"))).alias("min_d"))


def roll_gaps(df: DataFrame, *, instrument: str = "instrument", open_: str = "open", close: str = "close", key: str = "series_id", order: Sequence[str] = ("ts",), match_end: bool = True) -> DataFrame:
    """gap: sum of open less the close before, over the first rows of new contracts so far; less its total if match_end."""
    w = ordered(key, *order)
    first = F.row_number().over(Window.partitionBy(key, instrument).orderBy(*order)) == 1
    jump = F.when(first, F.coalesce(F.col(open_) - F.lag(close).over(w), F.lit(0.0))).otherwise(0.0)
    out = df.withColumn("_jump", jump)
    gap = F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("_jump").over(Window.partitionBy(key))
    return out.withColumn("gap", gap - whole if match_end else gap).drop("_jump")


def roll_futures(df: DataFrame, prices: Sequence[str] = ("close", "vwap"), **named) -> DataFrame:
    """Prices less the gaps of rolls."""
    out = roll_gaps(df, **named)
    return out.withColumns({c: F.col(c) - F.col("gap") for c in prices})


def pca_weights(cov: np.ndarray, risk: Sequence[float] | None = None, target: float = 1.0) -> np.ndarray:
    """Weights that spread risk over principal components as asked (all on the smallest by default)."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    share = np.zeros(len(values)) if risk is None else np.asarray(risk, float)
    if risk is None:
        share[-1] = 1.0
    return vectors @ (target * np.sqrt(share / values))
