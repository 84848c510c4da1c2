"""Seeded synthetic tables, made in parallel by row from hashed draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import normal, uniform


def classification_set(spark: SparkSession, n_features: int = 40, n_informative: int = 10, n_redundant: int = 10, n_samples: int = 10_000, seed: int = 0, days: int = 1) -> DataFrame:
    """id, t0, t1, bin, w and features I_* (informative), R_* (mixtures of them), N_* (noise)."""
    if n_informative + n_redundant > n_features:
        raise ValueError("more informative and redundant features than features")
    base = spark.range(n_samples)
    out = base.withColumns({f"I_{i}": normal(seed, i) for i in range(n_informative)})
    informative = [F.col(f"I_{i}") for i in range(n_informative)]
    score = sum((x * (1.0 if i % 2 == 0 else -1.0) for i, x in enumerate(informative)), F.lit(0.0)) + normal(seed, 999) * 0.5
    mixed = lambda j: sum((x * (((i * 7 + j * 3) % 5 - 2) / 2) for i, x in enumerate(informative)), F.lit(0.0))
    out = out.withColumns({f"R_{j}": mixed(j) for j in range(n_redundant)} | {f"N_{j}": normal(seed, 500 + j) for j in range(n_features - n_informative - n_redundant)})
    t0 = F.expr("TIMESTAMP_NTZ'2000-01-03 00:00:00'") + F.make_dt_interval((F.col("id") * days).cast("int"))
    return out.withColumn("bin", (score > 0).cast("int")).withColumns({"w": F.lit(1.0 / max(n_samples, 1)), "t0": t0, "t1": t0 + F.expr(f"INTERVAL {days} DAY")})


def price_walk(spark: SparkSession, start: float = 1000.0, mu: float = 0.0, var: float = 1.0, n_samples: int = 1_000_000, series: int = 1, seed: int = 0) -> DataFrame:
    """series_id, ts (minutes), seq, close: random walks, one window for each series."""
    rows = spark.range(n_samples * series).select((F.col("id") % series).alias("series_id"), F.floor(F.col("id") / series).alias("seq"), (mu + normal(seed, 0) * var**0.5).alias("_d"))
    w = Window.partitionBy("series_id").orderBy("seq")
    ts = F.expr("TIMESTAMP_NTZ'2000-01-01 00:00:00'") + F.make_dt_interval(mins=F.col("seq").cast("int"))
    return rows.select("series_id", ts.alias("ts"), "seq", (start + F.sum("_d").over(w)).alias("close"))


def _day(i: Column, business: bool) -> Column:
    first = F.expr("TIMESTAMP_NTZ'2000-01-03 00:00:00'")  # a Monday
    days = F.floor(i / 5) * 7 + i % 5 if business else i
    return first + F.make_dt_interval(days.cast("int"))


def random_intervals(spark: SparkSession, n_samples: int = 10_000, max_days: int = 5, business: bool = True, seed: int = 0) -> DataFrame:
    """t0 (days in order) and t1 = t0 + 1 to max_days days."""
    t0 = _day(F.col("id"), business)
    return spark.range(n_samples).select("id", t0.alias("t0"), (t0 + F.make_dt_interval((F.floor(uniform(seed, 0) * max_days) + 1).cast("int"))).alias("t1"))


def portfolio(spark: SparkSession, n_samples: int = 10_000, imbalance: bool = True, price: tuple[float, float] = (95.0, 1000.0), position: tuple[float, float] = (1000.0, 10_000.0), seed: int = 0) -> DataFrame:
    """Positions with prices, yields, expenses and labels (1: shares). imbalance: by price below 200, else below the 40 % quantile."""
    u = lambda k, lo, hi: lo + uniform(seed, k) * (hi - lo)
    t0 = _day(F.col("id"), True)
    out = spark.range(n_samples).select("id", t0.alias("t0"), (t0 + F.make_dt_interval((F.floor(uniform(seed, 0) * 5) + 1).cast("int"))).alias("t1"), u(1, *price).alias("open"), u(2, 0.8, 1.2).alias("_c"), F.round(u(3, *position)).alias("open_pos"), F.round(u(4, *position)).alias("close_pos"), u(5, 0.012, 0.12).alias("_y"), u(6, 0.005, 0.05).alias("_e"), u(7, 0.92, 0.95).alias("_o"))
    out = out.withColumn("close", F.col("open") * F.col("_c"))
    cut = F.lit(200.0) if imbalance else F.lit(price[0] + 0.4 * (price[1] - price[0]))  # the quantile of a uniform price
    return out.select("id", "t0", "t1", "open", "close", "open_pos", "close_pos", (F.col("_y") * F.col("close")).alias("yield"), (F.col("open") * F.col("_e")).alias("expense"), (F.col("open") < cut).cast("int").alias("label"), (F.col("open") * F.col("_o")).alias("clean_open"), ((1 - F.col("_y")) * F.col("close")).alias("clean_close"))


def correlated_returns(spark: SparkSession, n_obs: int = 10_000, size0: int = 5, size1: int = 5, sigma: float = 0.25, seed: int = 0) -> DataFrame:
    """ts, asset, ret in long form: size0 independent assets, size1 noisy copies of some, and rare shocks of -0.5 and 2 shared by a pair."""
    out = spark.range(n_obs)
    out = out.withColumns({f"a{i + 1}": normal(seed, i) * 0.01 for i in range(size0)})
    source = [(i * 7919 + seed) % size0 + 1 for i in range(size1)]
    out = out.withColumns({f"a{size0 + i + 1}": F.col(f"a{s}") + normal(seed, 100 + i) * sigma * 0.01 for i, s in enumerate(source)})
    shock = F.floor(uniform(seed, 999) * 1000)
    last = size0 + size1
    for place, size in ((1, -0.5), (2, 2.0)):
        for c in (f"a{source[-1] if source else 1}", f"a{last}"):
            out = out.withColumn(c, F.when(shock == place, size).otherwise(F.col(c)))
    names = [f"a{i + 1}" for i in range(last)]
    long = out.select(_day(F.col("id"), True).alias("ts"), F.explode(F.array(*(F.struct(F.lit(n).alias("asset"), F.col(n).alias("ret")) for n in names))).alias("x"))
    return long.select("ts", "x.asset", "x.ret")
