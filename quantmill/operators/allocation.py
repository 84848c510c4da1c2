"""Portfolio weights as frames: estimators in Spark, solvers on the matrix of assets."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import estimators as est
from . import solvers


def _frame(spark: SparkSession, names: Sequence, **columns) -> DataFrame:
    rows = [(str(n), *(float(c[i]) for c in columns.values())) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "asset string, " + ", ".join(f"{c} double" for c in columns))


def inputs(rets: DataFrame, frequency: float = 252, exponential: float | None = None) -> tuple[list, np.ndarray, np.ndarray]:
    """Assets, yearly mean returns and sample covariance of a long return frame."""
    names, cov = est.matrix(est.sample_covariance(rets))
    means = est.exponential_returns(rets, frequency, exponential) if exponential else est.mean_returns(rets, frequency)
    return names, est.vector(means, names), cov


def mean_variance(rets: DataFrame, solution: str = "min_volatility", bounds: solvers.Bounds | None = None, *, frequency: float = 252, exponential: float | None = None, **named) -> DataFrame:
    """asset, weight, and the portfolio's return, risk and sharpe on every row."""
    names, mean, cov = inputs(rets, frequency, exponential)
    out = solvers.solve(solution, mean, cov, bounds, **named)
    one = np.ones(len(names))
    return _frame(rets.sparkSession, names, weight=out["weights"], portfolio_return=out["return"] * one, risk=out["risk"] * one, sharpe=out["sharpe"] * one)


def custom_objective(rets: DataFrame, objective: Callable[[np.ndarray, np.ndarray, np.ndarray], float], constraints: Sequence[Callable[[np.ndarray], float]] = (), bounds: solvers.Bounds | None = None, **named) -> DataFrame:
    """Weights of the least objective(w, mean, cov) under constraints(w) >= 0, given as callables."""
    names, mean, cov = inputs(rets, **named)
    w = solvers.custom(len(names), lambda x: objective(x, mean, cov), bounds or solvers.bounds_of(len(names)), constraints)
    return _frame(rets.sparkSession, names, weight=w)


def _points(spark: SparkSession, names: Sequence, rows: Sequence[tuple[float, float, np.ndarray]]) -> DataFrame:
    out = [(k, ret, dev, str(n), float(x)) for k, (ret, dev, w) in enumerate(rows) for n, x in zip(names, w, strict=True)]
    return spark.createDataFrame(out, "point int, portfolio_return double, deviation double, asset string, weight double")


def efficient_frontier(rets: DataFrame, points: int = 100, bounds: solvers.Bounds | None = None, **named) -> DataFrame:
    names, mean, cov = inputs(rets, **named)
    return _points(rets.sparkSession, names, solvers.frontier(mean, cov, bounds, points))


def critical_line(rets: DataFrame, kind: str = "turning_points", bounds: solvers.Bounds | None = None, rf: float = 0.0, points: int = 100, **named) -> DataFrame:
    """Turning points (point, lambda, asset, weight), or weights of min_variance, max_sharpe, or the frontier."""
    names, mean, cov = inputs(rets, **named)
    line = solvers.CriticalLine(mean, cov, bounds)
    line.solve()
    spark = rets.sparkSession
    if kind == "turning_points":
        rows = [(k, None if lam is None else float(lam), str(n), float(x)) for k, (lam, w) in enumerate(line.points) for n, x in zip(names, w, strict=True)]
        return spark.createDataFrame(rows, "point int, lambda double, asset string, weight double")
    if kind == "frontier":
        return _points(spark, names, line.frontier(points))
    if kind not in ("min_variance", "max_sharpe"):
        raise ValueError("kind must be turning_points, frontier, min_variance or max_sharpe")
    return _frame(spark, names, weight=line.min_variance() if kind == "min_variance" else line.max_sharpe(rf))


def hierarchical(rets: DataFrame, method: str = "single", *, long_only: bool = True) -> DataFrame:
    names, cov = est.matrix(est.sample_covariance(rets))
    return _frame(rets.sparkSession, names, weight=solvers.hierarchical(cov, method, long_only=long_only))


def hierarchical_rescaled(rets: DataFrame, method: str = "single", n_run: int = 100, seed: int = 0) -> DataFrame:
    """Mean weights over the matrix and n_run random rescalings of it; runs are rows."""
    names, cov = est.matrix(est.sample_covariance(rets))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf["id"]:
                c = cov if i == 0 else solvers.rescaled(cov, np.random.default_rng([seed, i]))
                yield pd.DataFrame({"asset": list(map(str, names)), "w": solvers.hierarchical(c, method)})

    runs = rets.sparkSession.range(n_run + 1).mapInPandas(run, "asset string, w double")
    total = runs.groupBy("asset").agg(F.avg("w").alias("w"))
    from pyspark.sql import Window

    return total.select("asset", (F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(1)))).alias("weight"))


def nested_clusters(rets: DataFrame, *, min_variance: bool = True, most: int | None = None, frequency: float = 252, seed: int = 0) -> DataFrame:
    names, mean, cov = inputs(rets, frequency)
    return _frame(rets.sparkSession, names, weight=solvers.nested(cov, None if min_variance else mean, most, seed))


def nested_monte_carlo(rets: DataFrame, n_runs: int = 100, n_obs: int | None = None, width: float = 0.25, *, min_variance: bool = True, shrink: bool = False, seed: int = 0) -> DataFrame:
    """Root mean squared errors of convex and nested weights over simulated samples: method, error.

    n_obs: rows of each sample (by default as many as there are assets, plus one).
    """
    names, mean, cov = inputs(rets, 1.0)
    n = n_obs or len(names) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        truth = None if min_variance else mean
        right = solvers.convex(cov, truth)
        for pdf in batches:
            rows = []
            for i in pdf["id"]:
                rng = np.random.default_rng([seed, i])
                x = rng.multivariate_normal(mean, cov, size=n)
                m = x.mean(axis=0)
                c = np.cov(x, rowvar=False)
                if shrink:
                    c = 0.9 * c + 0.1 * np.trace(c) / len(c) * np.eye(len(c))
                if width > 0 and n > len(names):
                    c = solvers.denoised(c, n / len(names), width)
                for method, w in (("convex", solvers.convex(c, None if min_variance else m)), ("nested", solvers.nested(c, None if min_variance else m, seed=int(i)))):
                    rows.append((method, float(((w - right) ** 2).mean())))
            yield pd.DataFrame(rows, columns=["method", "e"])

    runs = rets.sparkSession.range(n_runs).mapInPandas(run, "method string, e double")
    return runs.groupBy("method").agg(F.sqrt(F.avg("e")).alias("error"))


def _long(spark: SparkSession, names: Sequence, m: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(str(a), str(b), float(m[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], "asset_i string, asset_j string, cov double")


def denoised_covariance(rets: DataFrame, width: float = 0.01, tn_relation: float | None = None) -> DataFrame:
    """Long covariance without the eigenvalues that noise explains; tn_relation: times over assets."""
    names, cov = est.matrix(est.empirical_covariance(rets))
    q = tn_relation or rets.select("ts").distinct().count() / len(names)
    return _long(rets.sparkSession, names, solvers.denoised(cov, q, width))


def _concentrated(wide: DataFrame, width: int, places: list[tuple[np.ndarray, np.ndarray]], share: float, centered: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and covariance of the share of rows nearest to each place (mean, covariance): one pass finds the bounds, one the sums."""

    def distances(x: np.ndarray) -> np.ndarray:
        return np.stack([np.einsum("ij,jk,ik->i", x - m, np.linalg.pinv(c), x - m) for m, c in places], axis=1)

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in distances(matrix(batch)).T], [f"d{i}" for i in range(len(places))])

    bounds = wide.mapInArrow(far, ", ".join(f"d{i} double" for i in range(len(places)))).agg(*(F.percentile_approx(f"d{i}", share, 100_000) for i in range(len(places)))).first()
    bounds = np.array(bounds, float)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = np.zeros(len(places)), np.zeros((len(places), width)), np.zeros((len(places), width, width))
        for batch in batches:
            x = matrix(batch)
            inside = distances(x) <= bounds
            for i, (m, _) in enumerate(places):
                part = x[inside[:, i]] - m
                n[i], one[i], two[i] = n[i] + len(part), one[i] + part.sum(axis=0), two[i] + part.T @ part
        yield pa.RecordBatch.from_arrays([pa.array(range(len(places))), pa.array(n), pa.array(one.tolist()), pa.array(two.reshape(len(places), -1).tolist())], ["i", "n", "one", "two"])

    parts = wide.mapInArrow(sums, "i bigint, n double, one array<double>, two array<double>")
    add = lambda c, w: F.array(*(F.sum(F.col(c)[k]) for k in range(w)))
    out = {r["i"]: r for r in parts.groupBy("i").agg(F.sum("n").alias("n"), add("one", width).alias("one"), add("two", width * width).alias("two")).collect()}
    made = []
    for i, (m, _) in enumerate(places):
        mean, square = np.array(out[i]["one"]) / out[i]["n"], np.array(out[i]["two"]).reshape(width, width) / out[i]["n"]
        made.append((m, square) if centered else (m + mean, square - np.outer(mean, mean)))
    return made


def robust_covariance(rets: DataFrame, support: float | None = None, centered: bool = False, starts: int = 10, seed: int = 0) -> DataFrame:
    """Minimum covariance determinant on all times at which all assets have a return.

    Concentration steps are aggregations over all rows: the driver holds ``starts`` matrices of
    N x N. Starts are small subsets that a hash of the time chooses; after two steps the best
    three go on until their determinant stays. The bound of the nearest rows is a quantile, exact
    up to 100,000 times and to 1e-5 of the rows beyond.
    """
    names = sorted(r[0] for r in rets.select("asset").distinct().collect())
    p = len(names)
    wide = rets.groupBy("ts").pivot("asset", names).agg(F.first("ret")).dropna().select("ts", F.array(*(F.col(f"`{n}`") for n in names)).alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    n = wide.count()
    share = support or (n + p + 1) // 2 / max(n, 1)
    first = np.array([r["x"] for r in wide.orderBy(F.xxhash64("ts", F.lit(seed)), "ts").limit(starts * (p + 1)).collect()]).reshape(-1, p)
    subsets = [first[lo : lo + p + 1] for lo in range(0, len(first), p + 1)]
    places = [(np.zeros(p) if centered else s.mean(axis=0), np.cov(s, rowvar=False, bias=True).reshape(p, p)) for s in subsets if len(s) > 1]
    x, size = wide.select("x"), lambda c: float(np.linalg.slogdet(c + 1e-300 * np.eye(p))[1])
    for _ in range(2):
        places = _concentrated(x, p, places, share, centered)
    places = sorted(places, key=lambda q: size(q[1]))[:3]
    for _ in range(30):
        before = [size(c) for _, c in places]
        places = _concentrated(x, p, places, share, centered)
        if all(not size(c) < b - 1e-9 for (_, c), b in zip(places, before, strict=True)):
            break
    wide.unpersist()
    return _long(rets.sparkSession, names, min(places, key=lambda q: size(q[1]))[1])
