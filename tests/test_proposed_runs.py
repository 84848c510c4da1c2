"""Monte Carlo runs from proposed events: their law, places by ranges, and no series in one task."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantmill.operators import bootstrap

from .test_draws_and_sweeps import law
from .test_zeros_and_sizes import plan

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("events", [[(0, 5), (1, 4), (3, 9), (8, 10)], [(0, 12), (0, 12), (0, 12)], [(0, 3), (1, 9)]])
def test_accepted_proposals_have_the_law_of_plain_draws(events):
    first, past = np.array([e[0] for e in events]), np.array([e[1] for e in events])
    expected, n, rng = law(first, past, 12, 3), 8_000, np.random.default_rng(4)
    seen = dict.fromkeys(expected, 0)
    for _ in range(n):
        proposed = rng.integers(len(events), size=100)
        taken = bootstrap.accepted(first[proposed], past[proposed], rng.random(100), 3)
        seen[tuple(proposed[taken].tolist())] += 1
    chi = sum((seen[d] - n * p) ** 2 / (n * p) for d, p in expected.items())
    free = len(expected) - 1
    assert chi < free + 4 * (2 * free) ** 0.5
    assert bootstrap.accepted(first, past, np.ones(len(events)), 1) is None


def test_shares_are_those_of_the_bars():
    rng = np.random.default_rng(2)
    for _ in range(50):
        first = rng.integers(0, 40, 12)
        past = first + rng.integers(0, 15, 12)
        alive = np.zeros(60)
        for a, b in zip(first, past, strict=True):
            alive[a:b] += 1
        for extra in (0, 1):
            assert [bootstrap.share_alone(first, past, a, b, extra) for a, b in zip(first, past, strict=True)] == pytest.approx(bootstrap.uniqueness(first, past, alive, extra))
        assert bootstrap._sample_share(first, past) == pytest.approx(bootstrap.sample_uniqueness(first, past, 60, np.arange(12)))


def test_places_are_those_of_a_search_in_the_bars(spark):
    rng = np.random.default_rng(3)
    at = lambda m: T0 + dt.timedelta(minutes=int(m))
    minutes = {k: rng.integers(0, 200, 90) for k in (1, 2)}
    bars = spark.createDataFrame([(k, at(m)) for k, ms in minutes.items() for m in ms], "series_id int, ts timestamp_ntz")
    made = [(k, int(a), None if i % 10 == 0 else int(a + rng.integers(0, 50))) for k in (1, 2) for i, a in enumerate(rng.integers(0, 220, 60))]
    events = spark.createDataFrame([(k, at(a), None if b is None else at(b)) for k, a, b in made], "series_id int, t0 timestamp_ntz, t1 timestamp_ntz")
    got = bootstrap._places(bars, events, "series_id", "ts").collect()
    for k in (1, 2):
        line = np.unique(minutes[k])
        first, past = bootstrap.spans(line, np.array([a for s, a, _ in made if s == k]), np.array([1000 if b is None else b for s, _, b in made if s == k]))
        rows = sorted((r for r in got if r.series_id == k), key=lambda r: r["_rank"])
        assert sorted((r["_first"], r["_past"]) for r in rows) == sorted(zip(first.tolist(), past.tolist(), strict=True))
        assert [r["_rank"] for r in rows] == list(range(60))
        assert [r["_bare"] for r in rows] == sorted(r["_bare"] for r in rows)


def test_no_task_takes_a_series(spark, monkeypatch):
    """Neither what a run reads nor what is written on the way gathers the bars or events of a series."""
    bars = spark.range(300).selectExpr("id % 3 AS series_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS int)) AS ts")
    events = bars.selectExpr("series_id", "ts AS t0", "ts + interval 7 hours AS t1")
    plans, kept = [], bootstrap.written
    monkeypatch.setattr(bootstrap, "written", lambda df, name: plans.append(plan(df)) or kept(df, name))
    out = bootstrap.monte_carlo_by_series(bars, events, 10, 11)
    assert len(plans) >= 2
    for p in [*plans, plan(out)]:
        assert not any(word in p for word in ("collect_list", "collect_set", "sort_array"))
    assert out.count() == 33


def test_rounds_go_on_until_all_runs_are_whole(spark):
    """Events that all meet refuse most proposals; a series without bars inside its events has equal chances."""
    bars = spark.createDataFrame([(k, T0 + dt.timedelta(hours=i)) for k in (1, 2) for i in range(30)], "series_id int, ts timestamp_ntz")
    inside = [(1, T0, T0 + dt.timedelta(hours=29))] * 40
    between = [(2, T0 + dt.timedelta(hours=i, minutes=10), T0 + dt.timedelta(hours=i, minutes=20)) for i in range(20)]
    out = bootstrap.monte_carlo_by_series(bars, spark.createDataFrame(inside + between, "series_id int, t0 timestamp_ntz, t1 timestamp_ntz"), 20, 9)
    rows = out.collect()
    assert sorted((r.series_id, r.run) for r in rows) == [(k, i) for k in (1, 2) for i in range(9)]
    assert all(r.standard == r.sequential == pytest.approx(1 / 20 if r.series_id == 1 else 0.0) for r in rows)
    assert out.where(F.col("standard").isNull() | F.col("sequential").isNull()).count() == 0
