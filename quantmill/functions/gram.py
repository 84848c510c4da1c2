"""Sums of products of all pairs of columns of a long table, by blocks.

A long table (ts, asset, value) becomes dense blocks of times and assets; a task takes one pair of
blocks of assets at one block of times and makes its sums with matrix products, and the sums of a pair of
blocks are added over the times. What is shuffled grows with the values times the number of
blocks of assets, not with the pairs of values; only the matrix that is asked for has a row for each pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import numbered

#: Assets and times of one block.
ASSETS, TIMES = 128, 2048

PLAIN = ("n", "si", "sj", "sij")
WEIGHTED = ("w", "wi", "wj", "wij")


def _sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each pair of columns, over the rows where both are there: count, sums, sum of products."""
    m, k = (~np.isnan(v) for v in (x, y))
    x, y = np.where(m, x, 0.0), np.where(k, y, 0.0)
    m, k = m.astype(float), k.astype(float)
    return np.stack([m.T @ k, x.T @ k, m.T @ y, x.T @ y])


def _decayed(x: np.ndarray, y: np.ndarray, keep: float) -> np.ndarray:
    """As _sums, each row weighted by keep to the number of common rows after it."""
    if not (np.isnan(x).any() or np.isnan(y).any()):
        back = keep ** np.arange(len(x) - 1, -1, -1.0)[:, None]
        one, other = np.ones_like(x), np.ones_like(y)
        return np.stack([(one * back).T @ other, (x * back).T @ other, one.T @ (y * back), (x * back).T @ y])
    out = np.zeros((4, x.shape[1], y.shape[1]))
    for a, b in zip(x, y, strict=True):
        there = ~np.isnan(a)[:, None] & ~np.isnan(b)
        a, b = np.nan_to_num(a)[:, None], np.nan_to_num(b)
        out = np.where(there, out * keep + np.stack(np.broadcast_arrays(1.0, a, b, a * b)), out)
    return out


def pair_sums(values: DataFrame, keep: float | None = None, centre: bool = True) -> DataFrame:
    """asset_i, asset_j, n, si, sj, sij of all pairs of assets with common times: count, sums and sum of products.

    values: ts, asset, value, each asset once a time; null and NaN are missing. centre: sums are of
    values less their asset's mean, which covariances do not depend on. keep: also w, wi, wj, wij, the same
    sums with each row weighted by keep to the number of common rows after it.
    """
    spark = values.sparkSession
    there = values.where(F.col("value").isNotNull() & ~F.isnan("value"))
    means = there.groupBy("asset").agg(F.avg("value").alias("m")).orderBy("asset").collect()  # the assets of an N x N matrix
    names = [r["asset"] for r in means]
    width = min(ASSETS, max(1, len(names)))
    blocks, kind = -(-len(names) // width), values.schema["asset"].dataType.simpleString()
    known = F.broadcast(spark.createDataFrame([(r["asset"], i, float(r["m"]) if centre else 0.0) for i, r in enumerate(means)], f"asset {kind}, _i int, _m double"))
    times = numbered(there.select("ts").distinct(), ["ts"], "_t")
    cells = there.join(known, "asset").join(times, "ts").select(
        F.floor(F.col("_i") / width).cast("int").alias("b"), (F.col("_i") % width).cast("int").alias("c"), F.floor(F.col("_t") / TIMES).cast("int").alias("k"), (F.col("_t") % TIMES).cast("int").alias("r"),
        (F.col("value") - F.col("_m")).alias("x"),
    )

    def pack(table: pa.Table) -> pa.Table:
        row, column, x = (table.column(c).to_numpy() for c in ("r", "c", "x"))
        dense = np.full((TIMES, width), np.nan)
        dense[row, column] = x
        return pa.table({"b": table.column("b")[:1], "k": table.column("k")[:1], "x": pa.array([dense.tobytes()], pa.binary())})

    packed = cells.groupBy("b", "k").applyInArrow(pack, "b int, k int, x binary")
    left = packed.select(F.col("b").alias("i"), F.explode(F.sequence("b", F.lit(blocks - 1))).alias("j"), "k", "x")
    right = packed.select(F.explode(F.sequence(F.lit(0), F.col("b"))).alias("ri"), F.col("b").alias("rj"), F.col("k").alias("rk"), F.col("x").alias("y"))
    parts = 4 if keep is None else 8

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"i": pa.array([], pa.int32()), "j": pa.array([], pa.int32()), "k": pa.array([], pa.int32()), "s": pa.array([], pa.binary())})
        x, y = (np.frombuffer(t.column(c)[0].as_py()).reshape(TIMES, width) for t, c in ((a, "x"), (b, "y")))
        rows, mine, other = (np.flatnonzero(v) for v in (~np.isnan(x).all(axis=1) | ~np.isnan(y).all(axis=1), ~np.isnan(x).all(axis=0), ~np.isnan(y).all(axis=0)))
        sums = _sums(x, y)
        if keep is not None:
            weighted = np.zeros_like(sums)
            weighted[:, mine[:, None], other] = _decayed(x[rows][:, mine], y[rows][:, other], keep)
            sums = np.concatenate([sums, weighted])
        return pa.table({"i": a.column("i"), "j": a.column("j"), "k": a.column("k"), "s": pa.array([sums.tobytes()], pa.binary())})

    products = left.groupBy("i", "j", "k").cogroup(right.groupBy("ri", "rj", "rk")).applyInArrow(multiply, "i int, j int, k int, s binary")
    fields = [*PLAIN, *(WEIGHTED if keep is not None else ())]

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((parts, width, width))
        for place in np.argsort(-table.column("k").to_numpy()):  # latest first: what is earlier has so many common rows after it
            s = np.frombuffer(table.column("s")[int(place)].as_py()).reshape(parts, width, width)
            if keep is not None:
                total[4:] += s[4:] * keep ** total[0]
            total[:4] += s[:4]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        row, column = np.nonzero(total[0])
        out = {"_i": row + i * width, "_j": column + j * width} | {f: total[p][row, column] for p, f in enumerate(fields)}
        if i != j:  # the other order of the same pairs
            swap = {"_i": "_j", "_j": "_i", "si": "sj", "sj": "si", "wi": "wj", "wj": "wi"}
            out = {f: np.concatenate([v, out[swap.get(f, f)]]) for f, v in out.items()}
        return pa.table({f: pa.array(v, pa.int32() if f in ("_i", "_j") else pa.float64()) for f, v in out.items()})

    sums = products.groupBy("i", "j").applyInArrow(add, "_i int, _j int, " + ", ".join(f"{f} double" for f in fields))
    name = lambda side: known.select(F.col("_i").alias(f"_{side}"), F.col("asset").alias(f"asset_{side}"))
    return sums.join(name("i"), "_i").join(name("j"), "_j").select("asset_i", "asset_j", *fields)
