"""Sequential draws against their law, percentiles and sweeps against plain loops."""

import datetime as dt
import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantmill.functions.scans import Percentile, Running, counts_below
from quantmill.operators import bootstrap, crossval, labels

T0 = dt.datetime(2024, 1, 1)


def law(first, past, n_bars, size):
    """The probability of every sequence of draws."""
    out = {}
    for draws in itertools.product(range(len(first)), repeat=size):
        alive, p = np.zeros(n_bars), 1.0
        for d in draws:
            w = bootstrap.uniqueness(first, past, alive)
            p *= w[d] / w.sum() if w.sum() else 1 / len(first)
            alive[first[d] : past[d]] += 1
        out[draws] = p
    return out


@pytest.mark.parametrize("block", [2, 512])
@pytest.mark.parametrize("events", [[(0, 5), (1, 4), (3, 9), (8, 10)], [(0, 12), (0, 12), (0, 12)], [(2, 2), (0, 3), (1, 9)], [(4, 4), (5, 5)]])
def test_draws_have_the_law_of_plain_draws(monkeypatch, block, events):
    monkeypatch.setattr(bootstrap.Alive, "BLOCK", block)
    first, past = np.array([e[0] for e in events]), np.array([e[1] for e in events])
    expected, n, rng = law(first, past, 12, 3), 12_000, np.random.default_rng(block)
    seen = dict.fromkeys(expected, 0)
    for _ in range(n):
        seen[tuple(bootstrap.lazy_draws(first, past, 12, 3, rng).tolist())] += 1
    assert all(seen[d] == 0 for d, p in expected.items() if p == 0)
    likely = [d for d, p in expected.items() if p > 0]
    chi = sum((seen[d] - n * expected[d]) ** 2 / (n * expected[d]) for d in likely)
    free = len(likely) - 1
    assert chi < free + 4 * (2 * free) ** 0.5


def test_sums_and_bounds():
    rng = np.random.default_rng(1)
    values = rng.random(100)
    sums, alive, plain = bootstrap.Sums(values), bootstrap.Alive(3000), np.zeros(3000)
    for _ in range(300):
        i = int(rng.integers(100))
        values[i] = rng.random() * (rng.random() < 0.7)
        sums.put(i, float(values[i]))
        assert sums.total() == pytest.approx(values.sum())
        u = rng.random() * values.sum()
        assert sums.place(u) == int(np.searchsorted(np.cumsum(values), u, side="right"))
        lo, hi = np.sort(rng.integers(0, 3001, 2)).tolist()
        alive.add(lo, hi)
        plain[lo:hi] += 1
        lo, hi = np.sort(rng.integers(0, 3001, 2)).tolist()
        want = (1 / (plain[lo:hi] + 1)).sum()
        low, high = alive.bounds(lo, hi)
        assert alive.exact(lo, hi) == pytest.approx(want) and low <= want + 1e-9 and want <= high + 1e-9


def test_events_that_all_meet_cost_few_looks_a_draw():
    n = 20_000
    first, past = np.arange(n), np.full(n, n)
    began = time.time()
    draws = bootstrap.lazy_draws(first, past, n, n, np.random.default_rng(0))
    assert len(draws) == n and time.time() - began < 60
    assert len(np.unique(draws)) > 0.55 * n


def test_monte_carlo_on_the_events_of_series(spark):
    bars = spark.createDataFrame([(k, T0 + dt.timedelta(hours=i)) for k in (1, 2) for i in range(40)], "series_id int, ts timestamp_ntz")
    starts = [0] * 6 + [2] * 4 + [10, 14, 18, 22, 26, 36]  # many that meet, and some alone
    events = spark.createDataFrame([(k, T0 + dt.timedelta(hours=i), T0 + dt.timedelta(hours=i + k) if i < 36 else None) for k in (1, 2) for i in starts], "series_id int, t0 timestamp_ntz, t1 timestamp_ntz")
    out = bootstrap.monte_carlo_by_series(bars, events, iterations=60)
    rows = out.collect()
    assert sorted((r.series_id, r.run) for r in rows) == [(k, i) for k in (1, 2) for i in range(60)]
    mean = lambda k, c: np.mean([r[c] for r in rows if r.series_id == k])
    assert all(mean(k, "sequential") > mean(k, "standard") for k in (1, 2))
    assert sorted(map(str, out.collect())) == sorted(map(str, rows))


def test_counts_below():
    rng = np.random.default_rng(2)
    for n, most in ((1, 1), (200, 5), (300, 300)):
        x = rng.integers(0, most, n)
        lo = rng.integers(0, n + 1, 400)
        hi = np.minimum(lo + rng.integers(0, n + 1, 400), n)
        bound = rng.integers(0, most + 1, 400)
        assert counts_below(x, lo, hi, bound).tolist() == [int((x[a:b] < v).sum()) for a, b, v in zip(lo, hi, bound, strict=True)]


@pytest.mark.parametrize("block_rows", [None, 16])
def test_percentiles(spark, block_rows):
    rng = random.Random(4)
    series = {k: [rng.choice([None, float("nan"), *range(6)]) for _ in range(n)] for k, n in ((None, 60), (1, 150), (2, 5))}
    rows = [(k, i, None if v is None else float(v)) for k, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "series_id int, ts int, close double").repartition(3)
    got = {(r.series_id, r.ts): r.percentile for r in labels.rolling_percentile(df, 21, block_rows=block_rows).collect()}
    want = {}
    for k, x in series.items():
        there = [(i, v) for i, v in enumerate(x) if v is not None and v == v]
        for j, (i, v) in enumerate(there):
            before = [w for _, w in there[max(0, j - 20) : j]]
            want[k, i] = None if len(before) < 20 else (sum(w < v for w in before) + sum(w <= v for w in before) + (v in before)) * 50.0 / 20
    assert got == want
    with pytest.raises(ValueError):
        labels.rolling_percentile(df, 1)


def test_a_wide_window_over_many_rows():
    x = np.random.default_rng(5).normal(size=200_000)
    kernel, state, began = Percentile("x", 10_000, "p"), np.zeros(0), time.time()
    for lo in range(0, len(x), 10_000):
        state, (out,) = kernel.run(state, x[lo : lo + 10_000])
    assert time.time() - began < 30
    i = len(x) - 1
    assert out[-1] == pytest.approx((2 * (x[i - 10_000 : i] < x[i]).sum()) * 50 / 10_000)


def test_running_maximum():
    x = np.array([np.nan, 2.0, np.nan, 1.0, 5.0])
    state, (out,) = Running("x", "m").run(np.full(1, np.nan), x)
    np.testing.assert_array_equal(out, [np.nan, 2, 2, 2, 5])
    assert state[0] == 5 and Running("x", "m").after(np.array([7.0]), Running("x", "m").summary(x))[0] == 7


@pytest.mark.parametrize("rows", [11, 1 << 20])
def test_train_times_sweep_equals_every_pair(spark, monkeypatch, rows):
    monkeypatch.setattr(crossval, "SWEEP_ROWS", rows)
    rng = random.Random(rows)
    at = lambda k: None if k is None else T0 + dt.timedelta(minutes=k)
    events = [(i, at(rng.choice([None, *range(200)])), at(rng.choice([None, *range(200)]))) for i in range(300)] + [(7, at(3), at(4))] * 2
    tests = [(at(s), at(s + rng.randint(-1, 3))) for s in rng.sample(range(200), 25)] + [(None, at(5)), (at(5), None)]
    e = spark.createDataFrame(events, "id int, t0 timestamp_ntz, t1 timestamp_ntz")
    t = spark.createDataFrame(tests, "start timestamp_ntz, end timestamp_ntz")
    proper = t.where("start <= end").alias("x")
    on = crossval.overlaps(F.col("e.t0"), F.col("e.t1"), F.col("x.start"), F.col("x.end"))
    want = e.alias("e").join(proper, on, "left_anti").collect()
    got = crossval.train_times(e, t)
    assert got.columns == e.columns and sorted(map(str, got.collect())) == sorted(map(str, want)) and len(want) > 20
    assert crossval.train_times(e, t.where("false")).count() == e.count() and crossval.train_times(e.where("false"), t).count() == 0


@pytest.mark.parametrize("textbook", [True, False])
@pytest.mark.parametrize("share", [0.0, 0.05])
def test_folds_by_ranges_are_those_by_windows(spark, textbook, share):
    rng = random.Random(9)
    rows = [(k, i, T0 + dt.timedelta(hours=rng.randrange(60)), None) for k, n in ((1, 83), (2, 7), (3, 2)) for i in range(n)]
    rows = [(k, i, t0, t0 + dt.timedelta(hours=rng.randrange(1, 6))) for k, i, t0, _ in rows]
    e = spark.createDataFrame(rows, "series_id int, id int, t0 timestamp_ntz, t1 timestamp_ntz").repartition(3)
    a, b = (sorted(map(tuple, crossval.purged_folds(e, 5, share, textbook=textbook, ranges=r).collect())) for r in (False, True))
    assert a == b and len(a) > 200
    kept = crossval.embargo(e, 0.1, key="series_id")
    assert kept.columns == e.columns and {r.series_id: r["count"] for r in kept.groupBy("series_id").count().collect()} == {1: 75, 2: 7, 3: 2}
    assert crossval.embargo(e, 0.5).count() == 46 and crossval.embargo(e.where("false"), 0.5).count() == 0


def test_bags_draw_the_same_however_rows_are_dealt_out(spark):
    rows = spark.range(4000).withColumn("x", F.col("id") * 2)
    bag = crossval.Bag(None, 3, 1.5, seed=2)
    draw = lambda df, m=0: {r.id: r["count"] for r in bag.drawn(df, m).groupBy("id").count().collect()}
    first = draw(rows)
    assert first == draw(rows.repartition(5)) != draw(rows, 1) and bag.drawn(rows, 0).columns == ["id", "x"]
    assert sum(first.values()) == pytest.approx(6000, rel=0.05) and 4000 - len(first) == pytest.approx(4000 * np.exp(-1.5), rel=0.1)
