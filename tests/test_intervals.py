"""Interval operators against direct counts, and their properties."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quantmill.operators import betsize, bootstrap, crossval, weights

from .compare import close, rows

T0 = dt.datetime(2024, 1, 1)


def at(n):
    return T0 + dt.timedelta(hours=n)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    bars = [(k, at(i), 100 + rng.random()) for k in (1, 2) for i in range(50)]
    events = [(k, at(s), at(s + rng.randint(0, 6)) if rng.random() < 0.95 else None, rng.choice([-1.0, 1.0]), rng.random() * 0.9 + 0.05) for k in (1, 2) for s in rng.sample(range(44), 25)]
    return (
        spark.createDataFrame(bars, "series_id int, ts timestamp_ntz, close double"),
        spark.createDataFrame(events, "series_id int, t0 timestamp_ntz, t1 timestamp_ntz, side double, prob double"), bars, events,
    )


def test_concurrency_and_uniqueness(data):
    b, e, bars, events = data
    alive = {(k, t): sum(k == x[0] and x[1] <= t and (x[2] is None or t <= x[2]) for x in events) for k, t, _ in bars}
    assert {(r.series_id, r.ts): r.n_events for r in weights.concurrent_events(b, e).collect()} == alive
    w = weights.uniqueness_weights(b, e).collect()
    assert len(w) == len(events) and all(0 < r.t_w <= 1 + 1e-12 for r in w)
    for r in w:
        mine = [1 / alive[r.series_id, t] for k, t, _ in bars if k == r.series_id and r.t0 <= t and (r.t1 is None or t <= r.t1)]
        assert r.t_w == pytest.approx(sum(mine) / len(mine))
    total = {r.series_id: (r.s, r.n) for r in weights.return_weights(b, e).groupBy("series_id").agg(F.sum("w").alias("s"), F.count("*").alias("n")).collect()}
    assert all(s == pytest.approx(n) for s, n in total.values())
    assert max(r.decay_w for r in weights.time_decay(weights.uniqueness_weights(b, e), 0.3).collect()) == pytest.approx(1)
    with pytest.raises(ValueError):
        weights.time_decay(e, -1)


def test_blocks_of_days_give_the_same_rows(spark, data):
    b, e, _, _ = data
    odd = spark.createDataFrame([(None, at(1), at(30), 1.0, 0.5), (1, at(3), at(3), 1.0, 0.5), (9, at(400), None, -1.0, 0.5)], e.schema)
    e = e.unionAll(odd).withColumn("signal", F.col("side") * F.col("prob"))
    b = b.unionAll(spark.createDataFrame([(None, at(2), 5.0), (1, None, 5.0), (9, at(500), 6.0)], b.schema))
    for run in (weights.concurrent_events, weights.uniqueness_weights, weights.return_weights):
        same(run(b, e), run(b, e, block_days=1))
    for run in (betsize.active_average, betsize.concurrent_bets):
        same(run(e), run(e, block_days=3))
    empty = weights.uniqueness_weights(b.where("false"), e.where("false"), block_days=1)
    assert empty.count() == 0


def same(a, b):
    even = lambda df: df.select(*(F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes))
    x, y = (rows(df.columns, even(df).collect()) for df in (a, b))  # rounded, for rows sorts by them
    assert len(x) == len(y) > 0 and a.columns == b.columns
    assert all(close(u, v) for p, q in zip(x, y, strict=True) for u, v in zip(p, q, strict=True))


def test_active_average(data):
    _, e, _, events = data
    s = e.withColumn("signal", F.col("side") * F.col("prob"))
    for r in betsize.active_average(s).collect():
        mine = [x[3] * x[4] for x in events if x[0] == r.series_id and x[1] <= r.ts and (x[2] is None or r.ts < x[2])]
        assert r.signal == pytest.approx(sum(mine) / len(mine) if mine else 0.0)


def test_purged_folds_do_not_overlap(data):
    _, e, _, _ = data
    rows = e.where("t1 is not null").withColumn("id", F.xxhash64("series_id", "t0"))
    for textbook in (False, True):
        folds = crossval.purged_folds(rows, 4, 0.1, textbook=textbook).join(rows.select("id", "t0", "t1"), "id").collect()
        for k in (1, 2):
            for f in range(4):
                test = sorted(((r.t0, r.t1) for r in folds if r.series_id == k and r.fold == f and r.role == "test"))
                s, z = (test[0][0] if textbook else test[0][1]), test[-1][1]
                train = [(r.t0, r.t1) for r in folds if r.series_id == k and r.fold == f and r.role == "train"]
                assert train and not any(s <= a <= z or s <= b <= z or (a <= s and z <= b) for a, b in train)
    with pytest.raises(ValueError):
        crossval.purged_folds(rows, 1)


def test_sequential_bootstrap_is_more_unique(spark, data):
    b, e, _, events = data
    draws = bootstrap.sequential_bootstrap(b, e, sample_len=12, seed=1)
    assert draws.groupBy("series_id").count().where("count = 12").count() == 2
    means = bootstrap.summary(bootstrap.random_monte_carlo(spark, iterations=400)).first()
    assert means.mean_sequential > means.mean_standard


def test_limit_prices(spark):
    df = spark.createDataFrame([(0, 100, 100.0, 115.0), (5, 100, 115.0, 115.0), (37, 100, 100.0, 115.0), (-40, 100, 120.0, 115.0)], "pos int, max_pos int, price double, forecast double")
    w = 10.0**2 * (0.95**-2 - 1)
    for r in betsize.dynamic_bet(df).collect():
        x = r.forecast - r.price
        target = int(x / (w + x * x) ** 0.5 * r.max_pos)
        assert (r.target, r.w) == (target, pytest.approx(w))
        if target == r.pos:
            assert r.limit is None
            continue
        sign = 1 if target >= r.pos else -1
        total = sum(r.forecast - j / r.max_pos * (w / (1 - (j / r.max_pos) ** 2)) ** 0.5 for j in range(abs(r.pos + sign), abs(target) + 1))
        assert r.limit == pytest.approx(total / abs(target - r.pos))
    assert [r[0] for r in spark.createDataFrame([(0.125,), (0.375,), (-3.0,)], "x double").select(betsize.discrete(F.col("x"), 0.25)).collect()] == [0.0, 0.5, -1.0]


def test_train_times_without_a_key_equal_every_pair(spark):
    import datetime
    import random

    from quantmill.operators import crossval

    rng = random.Random(6)
    at = lambda k: None if k is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=k)
    events = [(i, rng.choice([None, *range(40)]), rng.choice([None, *range(40)])) for i in range(150)]
    tests = [(s, s + rng.randint(-1, 4)) for s in rng.sample(range(40), 7)] + [(None, 5)]
    between = lambda x, s, e: x is not None and s is not None and s <= x <= e
    spans = lambda a, b, s, e: None not in (a, b, s) and a <= s and e <= b
    expected = {i for i, a, b in events if not any(between(a, s, e) or between(b, s, e) or (s is not None and s <= e and spans(a, b, s, e)) for s, e in tests)}
    e = spark.createDataFrame([(i, at(a), at(b)) for i, a, b in events], "id int, t0 timestamp_ntz, t1 timestamp_ntz")
    t = spark.createDataFrame([(at(s), at(x)) for s, x in tests], "start timestamp_ntz, end timestamp_ntz")
    assert {r.id for r in crossval.train_times(e, t).collect()} == expected
