"""Kernels on arrays against plain loops and pandas, in one task and in blocks."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantmill.functions.folds import Ewm
from quantmill.functions.scans import Decay, Filling, scan
from quantmill.operators import bars, filters, volatility

T0 = dt.datetime(2024, 1, 1)


def frame(spark, series):
    rows = [(k, T0 + dt.timedelta(seconds=i), i, None if v is None else float(v), f"row {i}") for k, values in series.items() for i, v in enumerate(values)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "series_id int, ts timestamp_ntz, seq long, close double, other string").repartition(3)


def ends(values, threshold):
    s, out = 0.0, []
    for i, v in enumerate(values):
        s += v or 0.0
        if s >= threshold:
            out.append(i)
            s = 0.0
    return out


def draws(kind, n, seed=0):
    rng = random.Random(seed)
    make = {"whole": lambda: rng.randint(0, 50), "cents": lambda: round(rng.uniform(0, 500), 2), "tenths": lambda: rng.randint(0, 9) / 10, "zeros": lambda: 0, "rare": lambda: rng.random() * (rng.random() < 0.02)}[kind]
    return [None if rng.random() < 0.05 else make() for _ in range(n)]


@pytest.mark.parametrize("kind", ["whole", "cents", "tenths", "zeros", "rare"])
@pytest.mark.parametrize("threshold", [0.5, 1, 10, 300, 1e9])
def test_filling_in_stretches_of_any_length(kind, threshold):
    values = draws(kind, 1500, 5)
    x = np.array([np.nan if v is None else v for v in values], float)
    want = ends(values, threshold)
    for size in (1, 70, 333, 1500):
        kernel = Filling("x", threshold)
        state, got = kernel.start(), []
        for lo in range(0, len(x), size):
            state, out = kernel.run(state, x[lo : lo + size])
            got += (np.flatnonzero(out[0]) + lo).tolist()
        assert got == want


@pytest.mark.parametrize("kind", ["whole", "zeros", "rare", "cents"])
def test_summaries_of_filling_say_what_a_stretch_leaves(kind):
    kernel = Filling("x", 40.0)
    for seed in range(20):
        x = np.array([v or 0.0 for v in draws(kind, 200, seed)])
        summary = kernel.summary(x)
        for s in (0.0, 1.0, 17.0, 39.0, 39.999):
            left = kernel.run(np.array([s]), x)[0][0]
            assert kernel.after(np.array([s]), summary)[0] == pytest.approx(left, abs=1e-9)
    with pytest.raises(ValueError):
        kernel.summary(np.array([1.0, -1.0]))


def test_filling_takes_negative_values_in_one_task():
    rng = np.random.default_rng(2)
    x = rng.normal(1, 3, 500)
    assert np.flatnonzero(Filling("x", 20).run(np.zeros(1), x)[1][0]).tolist() == ends(x.tolist(), 20)


@pytest.mark.parametrize("span", [1, 1.5, 4, 100, 5000])
def test_decay_equals_pandas_and_the_step(span):
    rng = np.random.default_rng(1)
    x = np.where(rng.random(3000) < 0.1, np.nan, 1000 + rng.normal(0, 1, 3000).cumsum())
    x[:3] = np.nan
    p = pd.Series(x).ewm(span=span)
    mean, std = p.mean().to_numpy(), p.std().to_numpy()
    step, kernel = Ewm(span), Decay("x", span, "m", "s")
    plain = []
    for v in x:
        step.add(None if np.isnan(v) else v)
        plain.append((step.mean if step.w else np.nan, np.nan if step.std is None else step.std))
    for size in (3000, 777, 1):
        state, parts = kernel.start(), []
        for lo in range(0, len(x), size):
            state, out = kernel.run(state, x[lo : lo + size])
            parts.append(out)
        got = [np.concatenate(v) for v in zip(*parts, strict=True)]
        np.testing.assert_allclose(got[0], [v[0] for v in plain], rtol=1e-9)
        np.testing.assert_allclose(got[1], [v[1] for v in plain], rtol=1e-6, atol=1e-9)
        if span > 1:
            np.testing.assert_allclose(got[0], mean, rtol=1e-9)
            np.testing.assert_allclose(got[1], std, rtol=1e-6, atol=1e-9)


def test_summaries_of_decay_compose():
    rng = np.random.default_rng(3)
    kernel = Decay("x", 20, "m")
    x = np.where(rng.random(400) < 0.2, np.nan, rng.normal(50, 2, 400))
    state = kernel.start()
    for lo, hi in ((0, 1), (1, 150), (150, 150), (150, 390), (390, 400)):
        if hi > lo:
            state = kernel.after(state, kernel.summary(x[lo:hi]))
    np.testing.assert_allclose(state, kernel.run(kernel.start(), x)[0], rtol=1e-9)


@pytest.mark.parametrize("block_rows", [None, 7, 64])
def test_blocks_give_the_same_rows(spark, block_rows):
    series = {None: draws("whole", 90, 1), 1: draws("whole", 700, 2), 2: [5], 3: draws("rare", 130, 3), 4: draws("cents", 200, 4)}
    df = frame(spark, series)
    got = bars.price_bars(df, 120, block_rows=block_rows)
    assert got.columns == df.columns
    found = got.collect()
    assert sorted((str(r.series_id), r.seq) for r in found) == sorted((str(k), i) for k, v in series.items() for i in ends(v, 120)) and all(r.other == f"row {r.seq}" for r in found)
    means = volatility.ewm(df, "close", 9, order=("seq",), mean="m", std="s", block_rows=block_rows).collect()
    assert len(means) == df.count()
    for k, values in series.items():
        want = pd.Series(values, dtype=float).ewm(span=9)
        mine = sorted((r.seq, r.m, r.s) for r in means if r.series_id == k)
        np.testing.assert_allclose(np.array([m[1] for m in mine], float), want.mean(), rtol=1e-9)
        np.testing.assert_allclose(np.array([m[2] for m in mine], float), want.std(), rtol=1e-6, atol=1e-9)
    empty = df.where("false")
    assert bars.price_bars(empty, 5, block_rows=block_rows).count() == 0 and filters.bands(empty, block_rows=block_rows).columns == [*df.columns, "ewm_mean", "upper", "lower"]


def test_key_among_the_columns_read(spark):
    df = frame(spark, {2: [1, 1, 1], 3: [1, 1]})
    for block_rows in (None, 2):
        assert sorted((r.series_id, r.seq) for r in scan(df, "series_id", ["seq"], Filling("series_id", 4), block_rows).collect()) == [(2, 1), (3, 1)]
    assert scan(df.withColumn("close", F.lit(None).cast("double")), "series_id", ["seq"], Filling("close", 4)).count() == 0
