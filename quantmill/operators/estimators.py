"""Return and risk estimators over long frames: ts, asset, and price or ret.

Covariances are long frames too (asset_i, asset_j, cov), made of sums of products by blocks of
assets and times (functions/gram.py); only the finished matrix of assets goes to a solver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gram import WEIGHTED, pair_sums
from ..functions.windows import nan_to_null


def returns(prices: DataFrame, unit: str | None = None) -> DataFrame:
    """Changes of price by asset; with a unit (day, week, month) of the last price of each bucket."""
    p = prices.where("price is not null")
    if unit:
        p = p.groupBy(F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("b"), "asset").agg(F.max_by("price", "ts").alias("price")).withColumnRenamed("b", "ts")
    w = Window.partitionBy("asset").orderBy("ts")
    return p.withColumn("ret", F.try_divide(F.col("price"), F.lag("price").over(w)) - 1).where("ret is not null").select("ts", "asset", "ret")


def mean_returns(rets: DataFrame, frequency: float = 252) -> DataFrame:
    return rets.groupBy("asset").agg((F.avg("ret") * frequency).alias("mean"))


def _last_weight(keys: list[str], span: float) -> Column:
    """Weight of each row in the last exponentially weighted mean of its group."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts"))) - 1
    return F.pow(F.lit(1 - 2 / (span + 1)), back)


def exponential_returns(rets: DataFrame, frequency: float = 252, span: float = 500) -> DataFrame:
    """Last exponentially weighted mean of each asset."""
    w = rets.withColumn("_w", _last_weight(["asset"], span))
    return w.groupBy("asset").agg((F.sum(F.col("_w") * F.col("ret")) / F.sum("_w") * frequency).alias("mean"))


def _pairs(rets: DataFrame, value: Column | None = None, **options) -> DataFrame:
    return pair_sums(rets.select("ts", "asset", (F.col("ret") if value is None else value).cast("double").alias("value")), **options)


def _covariance() -> Column:
    """Of the rows that both assets have, over their number."""
    return F.col("sij") / F.col("n") - F.col("si") / F.col("n") * F.col("sj") / F.col("n")


def sample_covariance(rets: DataFrame) -> DataFrame:
    return _pairs(rets).select("asset_i", "asset_j", F.when(F.col("n") > 1, _covariance() * F.col("n") / (F.col("n") - 1)).alias("cov"))


def empirical_covariance(rets: DataFrame, centered: bool = False) -> DataFrame:
    """Divided by T; centered: means are taken to be 0."""
    value = F.col("sij") / F.col("n") if centered else _covariance()
    return _pairs(rets, centre=not centered).select("asset_i", "asset_j", value.alias("cov"))


def shrunk_covariance(rets: DataFrame, kind: str = "basic", delta: float = 0.1) -> DataFrame:
    """(1 - d) S + d mu I: d fixed (basic), by Ledoit and Wolf (lw), or oracle approximating (oas)."""
    if kind not in ("basic", "lw", "oas"):
        raise ValueError("kind must be basic, lw or oas")
    s = empirical_covariance(rets)
    diagonal = F.col("asset_i") == F.col("asset_j")
    size = s.agg(F.sqrt(F.count("*")).alias("p"), (F.sum(F.when(diagonal, F.col("cov"))) / F.sqrt(F.count("*"))).alias("mu"), F.sum(F.col("cov") * F.col("cov")).alias("ss")).first()
    p, mu, ss = size["p"], size["mu"], size["ss"]
    if kind != "basic":
        t = rets.select("ts").distinct().count()
        if kind == "oas":
            alpha = ss / p**2
            below = (t + 1) * (alpha - mu * mu / p)
            delta = 1.0 if below == 0 else min((alpha + mu * mu) / below, 1.0)
        else:
            means = rets.groupBy("asset").agg(F.avg("ret").alias("m"))
            x = rets.join(means, "asset").groupBy("ts").agg(F.sum(F.pow(F.col("ret") - F.col("m"), 2)).alias("n2"))
            fourth = x.agg(F.sum(F.pow("n2", F.lit(2.0)))).first()[0]
            beta = (fourth / t - ss) / (p * t)
            spread = (ss - 2 * mu * mu * p + p * mu * mu) / p
            delta = 0.0 if beta == 0 else min(beta, spread) / spread
    return s.select("asset_i", "asset_j", ((1 - delta) * F.col("cov") + F.when(diagonal, delta * mu).otherwise(0.0)).alias("cov"))


def semi_covariance(rets: DataFrame, threshold: float = 0.0, *, by_assets: bool = True) -> DataFrame:
    """Mean product of shortfalls below the threshold; by_assets divides by T * N instead of T."""
    short = F.when(nan_to_null(F.col("ret").cast("double")).isNotNull(), F.least(F.col("ret") - threshold, F.lit(0.0)))
    low = _pairs(rets, short, centre=False)
    out = low.select("asset_i", "asset_j", (F.col("sij") / F.col("n")).alias("cov"))
    if not by_assets:
        return out
    n = F.count("*").over(Window.partitionBy("asset_i"))
    return out.withColumn("cov", F.col("cov") / n)


def exponential_covariance(rets: DataFrame, span: float = 60) -> DataFrame:
    """Last exponentially weighted mean of the products of deviations from the mean."""
    w, wi, wj, wij = (F.col(c) for c in WEIGHTED)
    mi, mj = F.col("si") / F.col("n"), F.col("sj") / F.col("n")
    product = (wij - mi * wj - mj * wi + mi * mj * w) / w
    return _pairs(rets, keep=1 - 2 / (span + 1)).select("asset_i", "asset_j", product.alias("cov"))


def to_correlation(cov: DataFrame) -> DataFrame:
    """corr within -1 and 1."""
    d = cov.where("asset_i = asset_j")
    out = cov.join(d.select("asset_i", F.sqrt("cov").alias("si")), "asset_i").join(d.select("asset_j", F.sqrt("cov").alias("sj")), "asset_j")
    corr = F.col("cov") / F.nullif(F.col("si") * F.col("sj"), F.lit(0.0))
    return out.select("asset_i", "asset_j", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), corr)).alias("corr"))


def to_covariance(corr: DataFrame, std: DataFrame) -> DataFrame:
    """corr (asset_i, asset_j, corr) and std (asset, std) to cov."""
    s = lambda n: std.select(F.col("asset").alias(f"asset_{n}"), F.col("std").alias(f"s{n}"))
    return corr.join(s("i"), "asset_i").join(s("j"), "asset_j").select("asset_i", "asset_j", (F.col("corr") * F.col("si") * F.col("sj")).alias("cov"))


def inverse_variance(rets: DataFrame) -> DataFrame:
    """weight of each asset in inverse proportion to its variance."""
    v = rets.groupBy("asset").agg(F.try_divide(F.lit(1.0), F.var_samp("ret")).alias("w"))
    return v.select("asset", (F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(1)))).alias("weight"))


def portfolio_variance(cov: DataFrame, weights: DataFrame) -> DataFrame:
    w = lambda n: weights.select(F.col("asset").alias(f"asset_{n}"), F.col("weight").alias(f"w{n}"))
    return cov.join(w("i"), "asset_i").join(w("j"), "asset_j").agg(F.sum(F.col("cov") * F.col("wi") * F.col("wj")).alias("variance"))


def higher_quantile(df: DataFrame, column: str, p: float, *, key: str = "asset") -> DataFrame:
    """The value at place ceil(p (n - 1)) of the sorted ones, by key: key, q."""
    w = Window.partitionBy(key).orderBy(column)
    rows = df.where(F.col(column).isNotNull()).select(key, F.col(column).alias("q"), F.row_number().over(w).alias("_i"), F.count("*").over(Window.partitionBy(key)).alias("_n"))
    return rows.where(F.col("_i") == F.ceil(F.round(p * (F.col("_n") - 1), 9)) + 1).select(key, "q")


def value_at_risk(rets: DataFrame, level: float = 0.05) -> DataFrame:
    return higher_quantile(rets, "ret", level).withColumnRenamed("q", "var")


def expected_shortfall(rets: DataFrame, level: float = 0.05) -> DataFrame:
    """Mean return below the value at risk (null if none is)."""
    v = value_at_risk(rets, level)
    return rets.join(v, "asset").groupBy("asset").agg(F.avg(F.when(F.col("ret") < F.col("var"), F.col("ret"))).alias("expected_shortfall"))


def conditional_drawdown(rets: DataFrame, level: float = 0.05) -> DataFrame:
    """Mean of the running greatest drawdowns at or above their (1 - level) quantile."""
    w = Window.partitionBy("asset").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    worst = rets.withColumn("_d", F.max("ret").over(w) - F.col("ret")).withColumn("_m", F.max("_d").over(w))
    q = higher_quantile(worst, "_m", 1 - level)
    return worst.join(q, "asset").groupBy("asset").agg(F.avg(F.when(F.col("_m") >= F.col("q"), F.col("_m"))).alias("conditional_drawdown"))


def matrix(cov: DataFrame, column: str = "cov") -> tuple[list, np.ndarray]:
    """Assets in order and their matrix, on the driver: N x N numbers, N the number of assets."""
    rows = cov.select("asset_i", "asset_j", column).collect()
    names = sorted({r[0] for r in rows})
    at = {n: i for i, n in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    for i, j, v in rows:
        out[at[i], at[j]] = v
    return names, out


def vector(means: DataFrame, names: list, column: str = "mean") -> np.ndarray:
    found = {r["asset"]: r[column] for r in means.select("asset", column).collect()}
    return np.array([found[n] for n in names], float)
