"""Back-test statistics of positions, returns and strategies."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normal
from ..functions.draws import normal as normal_draw
from ..functions.draws import uniform
from ..functions.folds import ordered_fold
from ..functions.intervals import covering
from ..functions.windows import divided, expanding, ordered

YEAR_DAYS = 365.2425
EULER = 0.5772156649015329


def flat_flips(positions: DataFrame, column: str = "pos", *, key: str = "series_id", ts: str = "ts") -> DataFrame:
    """Times at which a position becomes flat (nothing before counts as not flat) or changes sign, and the last time."""
    w = ordered(key, ts)
    before, now = F.lag(column).over(w), F.col(column)
    flat = (now == 0) & (before.isNull() | (before != 0))
    last = F.lead(ts).over(w).isNull()
    return positions.where(F.col(column).isNotNull()).withColumn("_f", flat | F.coalesce(now * before < 0, F.lit(False)) | last).where("_f").select(key, ts)


def _days(t: datetime, since: datetime) -> float:
    d = t - since
    return d.days + (d.seconds + d.microseconds / 1e6) / 86_400


def average_holding(positions: DataFrame, column: str = "pos", *, key: str = "series_id", ts: str = "ts") -> DataFrame:
    """holding_days: days from average entry to closing, weighted by what was closed; null if nothing was."""

    def start():
        return {"t0": None, "pos": None, "entry": 0.0, "held": 0.0, "weight": 0.0}

    def step(s: dict, row: dict):
        now, before = float(row[column]), s["pos"]
        if s["t0"] is None:
            s["t0"] = row[ts]
        t = _days(row[ts], s["t0"])
        if before is not None:
            change = now - before
            if change * before >= 0:
                if now != 0:
                    s["entry"] = (s["entry"] * before + t * change) / now
            else:
                flipped = now * before < 0
                closed = abs(before) if flipped else abs(change)
                s["held"] += (t - s["entry"]) * closed
                s["weight"] += closed
                if flipped:
                    s["entry"] = t
        s["pos"] = now
        return None

    def finish(k, s: dict):
        return {key: k, "holding_days": s["held"] / s["weight"] if s["weight"] > 0 else None}

    kind = positions.schema[key].dataType.simpleString()
    return ordered_fold(positions.where(F.col(column).isNotNull()).select(key, ts, column), key, [ts], start, step, f"{key} {kind}, holding_days double", finish)


def time_weighted(book: DataFrame, *, key: str = "series_id", block_days: int | None = None) -> DataFrame:
    """At every start or end of a position: tw_return = geometric mean of the growth of the active ones, less 1.

    growth = 1 + (pnl - expense) / (close * open_pos + close * added), where pnl is the price
    change by label (0: clean prices) plus yield, times the volume closed. Growth of exactly 1
    does not count as active; a growth of 0 or less has no mean and gives null. block_days deals
    long series out by days (functions/intervals.py).
    """
    added = F.greatest(F.lit(0.0), F.col("close_pos") - F.col("open_pos"))
    change = F.when(F.col("label") == 0, F.col("clean_close") - F.col("clean_open")).otherwise(F.col("close") - F.col("open"))
    pnl = (change + F.col("yield")) * (F.col("open_pos") - F.col("close_pos"))
    grown = book.withColumn("growth", 1 + F.try_divide(pnl - F.col("expense"), F.col("close") * F.col("open_pos") + F.col("close") * added)).where("growth is not null")
    points = grown.select(key, F.col("t0").alias("ts")).unionAll(grown.select(key, F.col("t1").alias("ts"))).distinct()
    good = F.col("growth") > 0
    values = {"_l": F.when(good, F.log("growth")).otherwise(0.0), "_n": F.when(good & (F.col("growth") != 1), 1.0).otherwise(0.0), "_bad": F.when(good, 0.0).otherwise(1.0)}
    out = covering(points, grown.select(key, "t0", "t1", "growth"), key, "ts", values, block_days=block_days)
    return out.select(key, "ts", F.when((F.round("_bad") == 0) & (F.round("_n") > 0), F.exp(F.col("_l") / F.col("_n")) - 1).alias("tw_return"))


def _hhi(x: Column) -> Column:
    n, share = F.count(x), divided(F.sum(x * x), F.pow(F.sum(x), F.lit(2.0)))
    return F.when(n > 2, (share - 1 / n) / (1 - 1 / n))


def concentration(returns: DataFrame, column: str = "ret", *, key: str = "series_id", ts: str = "ts", unit: str = "month") -> DataFrame:
    """Normalised Herfindahl indices: hhi_pos, hhi_neg of returns, hhi_time of counts by period (empty ones too)."""
    r = F.col(column)
    sizes = returns.groupBy(key).agg(_hhi(F.when(r >= 0, r)).alias("hhi_pos"), _hhi(F.when(r < 0, r)).alias("hhi_neg"))
    period = F.date_trunc(unit, ts).cast("timestamp_ntz")
    counts = returns.where(r.isNotNull()).groupBy(key, period.alias("p")).agg(F.count("*").cast("double").alias("n"))
    calendar = counts.groupBy(key).agg(F.explode(F.sequence(F.min("p"), F.max("p"), F.expr(f"INTERVAL 1 {unit}"))).alias("p"))
    time = calendar.join(counts, [key, "p"], "left").groupBy(key).agg(_hhi(F.coalesce("n", F.lit(0.0))).alias("hhi_time"))
    return sizes.join(time, key, "left")


def drawdowns(df: DataFrame, column: str = "close", *, key: str = "series_id", ts: str = "ts", dollars: bool = False) -> DataFrame:
    """At each high watermark with a loss after it: drawdown, and years until the next such one (the last: until the end)."""
    w = ordered(key, ts)
    marked = df.where(F.col(column).isNotNull()).select(key, ts, F.col(column).alias("_x"), expanding(F.max, F.col(column), w).alias("hwm"))
    by_mark = marked.groupBy(key, "hwm").agg(F.min("_x").alias("_min"), F.min(ts).alias(ts), F.max(ts).alias("_end"))
    whole = by_mark.withColumn("_end", F.max("_end").over(Window.partitionBy(key))).where("hwm > _min")
    until = F.coalesce(F.lead(ts).over(w), F.col("_end"))
    micros = F.timestamp_diff("MICROSECOND", F.col(ts), until)
    loss = F.col("hwm") - F.col("_min") if dollars else 1 - F.try_divide("_min", "hwm")
    return whole.select(key, ts, "hwm", loss.alias("drawdown"), (micros / (86_400e6 * YEAR_DAYS)).alias("under_water"))


def return_distribution(returns: DataFrame, column: str = "ret", *, key: str = "series_id") -> DataFrame:
    r = F.col(column)
    up, down = F.when(r > 0, r), F.when(r <= 0, r)
    return returns.groupBy(key).agg(F.count(up).alias("n_up"), F.avg(up).alias("mean_up"), F.count(down).alias("n_down"), F.avg(down).alias("mean_down"))


def annualized_return(df: DataFrame, column: str = "close", *, key: str = "series_id", ts: str = "ts", t_days: float = 252) -> DataFrame:
    """(last / first) ^ (t_days / calendar days) - 1."""
    ends = df.where(F.col(column).isNotNull()).groupBy(key).agg(F.min_by(column, ts).alias("_a"), F.max_by(column, ts).alias("_z"), F.min(ts).alias("_t0"), F.max(ts).alias("_t1"))
    days = F.timestamp_diff("MICROSECOND", F.col("_t0"), F.col("_t1")) / 86_400e6
    return ends.select(key, (F.pow(F.try_divide("_z", "_a"), t_days / F.nullif(days, F.lit(0.0))) - 1).alias("annualized"))


def sharpe(returns: DataFrame, column: str = "ret", rf: float = 0.0, t_days: float = 252, *, key: str = "series_id") -> DataFrame:
    return returns.groupBy(key).agg(((F.avg(column) - rf) / F.nullif(F.stddev_samp(column), F.lit(0.0)) * math.sqrt(t_days)).alias("sharpe"))


def information_ratio(returns: DataFrame, column: str = "ret", benchmark: Column | float = 0.0, t_days: float = 252, *, key: str = "series_id") -> DataFrame:
    excess = F.col(column) - (benchmark if isinstance(benchmark, Column) else F.lit(benchmark))
    return sharpe(returns.withColumn("_e", excess), "_e", 0.0, t_days, key=key).withColumnRenamed("sharpe", "information_ratio")


def probabilistic_sharpe(sr: Column, benchmark: Column, n: Column, skew: Column, kurt: Column) -> Column:
    """Probability that the true ratio is above the benchmark; kurt is not in excess."""
    spread = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    return F.when(spread > 0, normal.cdf((sr - benchmark) * F.sqrt(n - 1) / F.sqrt(F.when(spread > 0, spread))))


def expected_max_sharpe(deviation: Column, trials: int) -> Column:
    """Expected largest of so many ratios with this deviation."""
    return deviation * ((1 - EULER) * normal.ppf(1 - 1 / trials) + EULER * normal.ppf(1 - 1 / (trials * math.e)))


def deflated_sharpe(sr: Column, deviation: Column, trials: int, n: Column, skew: Column, kurt: Column) -> tuple[Column, Column]:
    """The deflated ratio and the benchmark it is held against."""
    bar = expected_max_sharpe(deviation, trials)
    return probabilistic_sharpe(sr, bar, n, skew, kurt), bar


def min_track_record(sr: Column, benchmark: Column, skew: Column, kurt: Column, alpha: float = 0.05) -> Column:
    z = normal.ppf(1 - alpha)
    return 1 + (1 - skew * sr + (kurt - 1) / 4 * sr * sr) * F.pow(z / F.nullif(sr - benchmark, F.lit(0.0)), F.lit(2.0))


def implied_precision(freq: Column, sharpe_target: Column, up: Column, down: Column) -> Column:
    """Share of gains at which bets of size up or down reach the ratio."""
    a, b = (freq + sharpe_target * sharpe_target) * F.pow(up - down, F.lit(2.0)), (2 * freq * down - sharpe_target * sharpe_target * (up - down)) * (up - down)
    c = freq * down * down
    return F.try_divide(-b + F.sqrt(b * b - 4 * a * c), 2 * a)


def implied_frequency(p: Column, sharpe_target: Column, up: Column, down: Column) -> Column:
    d = up - down
    return F.try_divide(F.pow(sharpe_target * d, F.lit(2.0)) * p * (1 - p), F.pow(d * p + down, F.lit(2.0))).cast("bigint")


def _edge(freq: Column, p: Column, sharpe_target: Column) -> Column:
    """sharpe * sqrt(p (1-p) / freq): mean gain over the range of outcomes."""
    return sharpe_target * F.sqrt(p * (1 - p) / freq)


def implied_profit(freq: Column, sharpe_target: Column, p: Column, loss: Column) -> Column:
    """Gain at which the ratio is reached, given the (negative) loss."""
    e = _edge(freq, p, sharpe_target)
    return loss - loss / F.nullif(p - e, F.lit(0.0))


def implied_loss(freq: Column, p: Column, gain: Column, sharpe_target: Column) -> Column:
    """(Negative) loss at which the ratio is reached, given the gain."""
    e = _edge(freq, p, sharpe_target)
    return gain * (p - e) / F.nullif(p - e - 1, F.lit(0.0))


def failure_probability(returns: DataFrame, freq: float, sharpe_target: float, column: str = "ret", *, key: str = "series_id") -> DataFrame:
    """p_fail: Phi((threshold - p) / (p (1 - p))) with p the share of gains and the threshold implied by mean gain and loss.

    The variance stands where a deviation is usual.
    """
    r = F.col(column)
    s = returns.where(r.isNotNull()).groupBy(key).agg(F.avg(F.when(r > 0, r)).alias("up"), F.avg(F.when(r <= 0, r)).alias("down"), F.avg((r > 0).cast("double")).alias("p"))
    bar = implied_precision(F.lit(float(freq)), F.lit(float(sharpe_target)), F.col("up"), F.col("down"))
    return s.withColumn("threshold", bar).withColumn("p_fail", normal.cdf(F.try_divide(F.col("threshold") - F.col("p"), F.col("p") * (1 - F.col("p"))))).select(key, "p", "threshold", "p_fail")


# Monte Carlo: one row for each run or node, each with its own seed.


def binomial_sharpe(spark: SparkSession, p: float = 0.5, up: float = 0.02, down: float = -0.02, freq: int = 52, n_run: int = 1_000_000, seed: int = 0) -> DataFrame:
    """Sharpe ratios of simulated bets: mean, std, ratio, and the share of ratios at most 0.2."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            wins = np.array([np.random.default_rng([seed, i]).binomial(freq, p) for i in pdf["id"]])
            mean = (wins * up + (freq - wins) * down) / freq
            dev = (up - down) * np.sqrt(wins * (freq - wins)) / freq
            yield pd.DataFrame({"sr": np.where(dev > 0, mean / np.where(dev > 0, dev, 1), np.nan)})

    runs = spark.range(n_run).mapInPandas(run, "sr double").where(~F.isnan("sr"))
    return runs.agg(F.avg("sr").alias("mean"), F.stddev_pop("sr").alias("std"), (F.avg("sr") / F.stddev_pop("sr")).alias("ratio"), F.avg((F.col("sr") <= 0.2).cast("double")).alias("share_low"))


def mixed_gaussians(spark: SparkSession, mu1: float, mu2: float, sig1: float, sig2: float, p: float, n_obs: int, seed: int = 0) -> DataFrame:
    """id, ret: a row is of the first distribution with probability p."""
    first = uniform(seed, 0) < p
    return spark.range(n_obs).withColumn("ret", F.when(first, mu1 + sig1 * normal_draw(seed, 1)).otherwise(mu2 + sig2 * normal_draw(seed, 2)))


def strategy_failure(spark: SparkSession, mu1: float, mu2: float, sig1: float, sig2: float, p: float, n_obs: int, freq: float, sharpe_target: float, seed: int = 0, limit: float = 0.05) -> DataFrame:
    """p_fail of a simulated strategy and whether it is to be discarded."""
    sample = mixed_gaussians(spark, mu1, mu2, sig1, sig2, p, n_obs, seed).withColumn("series_id", F.lit("strategy"))
    return failure_probability(sample, freq, sharpe_target).withColumn("discard", F.col("p_fail") > limit)


def trading_rules(spark: SparkSession, profits: Sequence[float] = tuple(np.linspace(0.5, 10, 20)), losses: Sequence[float] = tuple(np.linspace(0.5, 10, 20)), sigmas: Sequence[float] = (1,), forecasts: Sequence[float] = (10, 5, 0, -5, -10),
                  half_lives: Sequence[float] = (5, 10, 25, 50, 100), n_run: int = 100, max_period: int = 100, start: float = 0.0, seed: int = 0) -> DataFrame:
    """mean, std and sharpe of exits at profit or loss on mean-reverting paths, for every node of the grid."""
    grid = spark.range(1)
    for name, values in (("forecast", forecasts), ("half_life", half_lives), ("sigma", sigmas), ("profit", profits), ("loss", losses)):
        grid = grid.withColumn(name, F.explode(F.array(*(F.lit(float(v)) for v in values))))
    names = ["forecast", "half_life", "sigma", "profit", "loss"]
    nodes = grid.select(F.xxhash64(F.lit(seed), *names).alias("node"), *names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                rng = np.random.default_rng(abs(int(r.node)))
                phi = 2 ** (-1 / r.half_life)
                price, gain, alive = np.full(n_run, start), np.zeros(n_run), np.ones(n_run, bool)
                for period in range(1, max_period + 2):
                    price[alive] = (1 - phi) * r.forecast + phi * price[alive] + r.sigma * rng.standard_normal(int(alive.sum()))
                    gain[alive] = price[alive] - start
                    alive &= ~((gain > r.profit) | (gain < -r.loss) | (period > max_period))
                    if not alive.any():
                        break
                mean, std = gain.mean(), gain.std()
                out.append((r.forecast, r.half_life, r.sigma, r.profit, r.loss, mean, std, mean / std if std > 0 else np.nan))
            yield pd.DataFrame(out, columns=[*names, "mean", "std", "sharpe"])

    return nodes.repartition(64).mapInPandas(run, ", ".join(f"{n} double" for n in (*names, "mean", "std", "sharpe")))
