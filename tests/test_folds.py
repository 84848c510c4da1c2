"""Order-dependent operators against plain loops."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantmill.functions.folds import Ewm, ordered_scan
from quantmill.operators import backtest, bars, filters, labels, volatility

T0 = dt.datetime(2024, 1, 1)


def series(spark, values, name=1, gap=60):
    rows = [(name, T0 + dt.timedelta(seconds=gap * i), i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id int, ts timestamp_ntz, seq long, close double")


def walk(n, seed=0):
    rng = random.Random(seed)
    out = [100.0]
    for _ in range(n - 1):
        out.append(out[-1] + rng.gauss(0, 1))
    return out


def test_cusum_equals_loop(spark):
    x = walk(500)
    up = down = 0.0
    fired = []
    for i in range(1, len(x)):
        d = x[i] - x[i - 1]
        up, down = max(0, up + d), min(0, down + d)
        if up >= 3:
            fired.append(i)
            up = 0
        elif down <= -3:
            fired.append(i)
            down = 0
    got = filters.cusum_events(series(spark, x), 3.0)
    assert sorted(r.seq for r in got.collect()) == fired
    by_mean = filters.cusum_events(series(spark, x).withColumn("h", F.lit(3.0)), "h")
    assert by_mean.count() == len(fired) and by_mean.columns[-1] == "h"
    with pytest.raises(ValueError):
        filters.cusum_events(series(spark, x), 0)


def test_bars_discard_the_overshoot(spark):
    got = bars.price_bars(series(spark, [4.0, 7.0, None, 1.0, 9.0, 2.0]), 10)
    assert [r.seq for r in got.orderBy("seq").collect()] == [1, 4]
    assert bars.price_bars(series(spark, []), 10).count() == 0


def test_scan_passes_rows_through(spark):
    rows = [(k, i, v, {"x": [v]}, None) for k in (None, 1, 2) for i, v in enumerate([1.0, None, float("nan"), 4.0])]
    df = spark.createDataFrame(rows, "key int, i int, v double, m map<string, array<double>>, empty string")

    def step(state, v):
        state[0] += 1
        return [state[0], v]

    got = ordered_scan(df, "key", ["i"], lambda: [0.0], step, ["v"], ["n", "again"])
    assert got.columns == [*df.columns, "n", "again"]
    out = {(r.key, r.i): r for r in got.collect()}
    assert len(out) == 12 and all(r.n == r.i + 1 and r.empty is None for r in out.values())
    assert all((r.v is None) == (r.again is None) and str(r.v) == str(r.again) and str(r.m["x"][0]) == str(r.v) for r in out.values())
    picked = ordered_scan(df, "key", ["i"], lambda: None, lambda _, v: v == 4.0, ["v"])
    assert {(r.key, r.i) for r in picked.collect()} == {(k, 3) for k in (None, 1, 2)}
    assert ordered_scan(df.where("false"), "key", ["i"], lambda: [0.0], step, ["v"], ["n", "again"]).count() == 0


def test_ewm_equals_pandas():
    x = pd.Series([1.0, np.nan, 3.0, 2.0, np.nan, np.nan, 7.0, 5.0])
    mean, std = x.ewm(span=4).mean(), x.ewm(span=4).std()
    e = Ewm(4)
    for i, v in enumerate(x):
        e.add(None if math.isnan(v) else v)
        assert e.mean == pytest.approx(mean[i])
        assert (e.std is None) == math.isnan(std[i]) and (e.std is None or e.std == pytest.approx(std[i]))
    with pytest.raises(ValueError):
        Ewm(0)


def test_holding_period_of_one_trade(spark):
    days = [0.0, 10.0, 10.0, 5.0, 0.0]
    rows = [(1, T0 + dt.timedelta(days=i), v) for i, v in enumerate(days)]
    got = backtest.average_holding(spark.createDataFrame(rows, "series_id int, ts timestamp_ntz, pos double")).first()
    assert got.holding_days == pytest.approx((2 * 5 + 3 * 5) / 10)
    flat = spark.createDataFrame([(1, T0, 0.0)], "series_id int, ts timestamp_ntz, pos double")
    assert backtest.average_holding(flat).first().holding_days is None


def test_imbalance_loop(spark):
    x = walk(200, 3)
    got = bars.imbalance_bars(series(spark, x), 4, 0.2).orderBy("seq").collect()
    n = theta = up = 0
    cum = wc = ws = wt = 0.0
    for r, (a, b) in zip(got, zip(x, x[1:], strict=False), strict=True):
        ret = b / a - 1
        n, cum = n + 1, cum + ret
        theta, up = (theta + 1, up + 1) if ret >= 0 else (theta - 1, up)
        u, imb = max(theta, up), 0.0
        if u >= 4:
            wt, ws, wc = u + 0.8 * wt, u / n + 0.8 * ws, 1 + 0.8 * wc
            imb = wt * ws / wc**2
            theta, up = (theta, 0) if u == up else (0, up)
        assert r.cum_ret == pytest.approx(cum) and r.imbalance == pytest.approx(imb)


def test_lagged_return_is_strict(spark):
    df = series(spark, [1.0, 2.0, 4.0], gap=3600)
    got = {r.seq: r.ret for r in volatility.lagged_return(df, period="hours").collect()}
    assert got == {2: 3.0}  # the bar exactly one hour before does not count
    with pytest.raises(ValueError):
        volatility.lagged_return(df, period="weeks")


def test_barriers(spark):
    p = series(spark, [100.0, 101.0, 96.0, 104.0, 100.0], gap=86_400)
    e = spark.createDataFrame([(1, T0, None, 0.03, 1.0)], "series_id int, t0 timestamp_ntz, t1 timestamp_ntz, trgt double, side double")
    day = lambda n: T0 + dt.timedelta(days=n)
    r = labels.barrier_touches(p, e, 1, 1).first()
    assert (r.sl, r.pt) == (day(2), day(3))
    assert labels.barrier_touches(p, e, 1, 0).first().sl is None
    out = labels.triple_barrier(p, e, 0.01, [1, 1], path="bars").first()
    assert out.t1 == day(2)
    assert labels.triple_barrier(p, e, 0.03, path="bars").count() == 0  # strictly above
    m = labels.meta_label(p, labels.triple_barrier(p, e, 0.01, path="bars")).first()
    assert m.ret == pytest.approx(-0.04) and m.bin == 0
    assert labels.vertical_barrier(p, e, freq=10).count() == 0
    assert [r.t1 for r in labels.vertical_barrier(p, e, freq=1.5).collect()] == [day(2)]
    with pytest.raises(ValueError):
        labels.triple_barrier(p, e, 0.0, path="ticks")


def test_drop_rare(spark):
    df = spark.createDataFrame([(b,) for b in [1] * 60 + [-1] * 38 + [0] * 2], "bin int")
    assert {r.bin for r in labels.drop_rare(df).distinct().collect()} == {1, -1}
    assert labels.drop_rare(df.where("bin != -1"), 0.5).count() == 62
