"""Places by ranges, permutations and first crossings against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quantmill.functions import crossing
from quantmill.functions.ranks import numbered, permuted, ranked
from quantmill.operators import labels

T0 = dt.datetime(2024, 1, 1)


def at(n):
    return None if n is None else T0 + dt.timedelta(minutes=n)


@pytest.fixture
def many_partitions(spark):
    """So that series go on from one partition to the next."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_ranked(spark, many_partitions):
    rng = random.Random(1)
    rows = [(k, i, rng.random()) for k, n in ((None, 30), (1, 500), (2, 1), (3, 90)) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key int, i int, x double").repartition(5)
    out = ranked(df, "key", ["i"])
    assert out.columns == ["key", "i", "x", "_rank"] and sorted(out.select("key", "i", "x").collect(), key=str) == sorted(df.collect(), key=str)
    assert all(r["_rank"] == r["i"] for r in out.collect())
    assert ranked(df.where("false"), "key", ["i"]).count() == 0
    assert sorted(r["_rank"] for r in numbered(df, ["x"]).collect()) == list(range(len(rows)))
    ties = ranked(spark.createDataFrame([(1, 0)] * 40, "key int, i int"), "key", ["i"])
    assert sorted(r["_rank"] for r in ties.collect()) == list(range(40))


@pytest.mark.parametrize("n", [60, 100_000])
def test_permutation_leaves_about_one_row_in_place(spark, many_partitions, n):
    df = spark.range(n).selectExpr("id", "id * 2 AS x", "id % 7 AS y")
    fixed = []
    for seed in (1, 2, 3, 4):
        out = permuted(df, ["x"], seed)
        rows = out.selectExpr("count(*) n", "count(DISTINCT x) d", "sum(CASE WHEN x = id * 2 THEN 1 ELSE 0 END) f", "sum(CASE WHEN y = id % 7 THEN 1 ELSE 0 END) same").first()
        assert out.columns == df.columns and (rows["n"], rows["d"], rows["same"]) == (n, n, n)
        fixed.append(rows["f"])
    assert sum(fixed) <= 14  # one in the mean, Poisson


def test_permutation_depends_on_seed_and_rows_only(spark, many_partitions):
    df = spark.range(500).selectExpr("id", "id AS x", "-id AS y")
    a = {r["id"]: (r["x"], r["y"]) for r in permuted(df, ["x", "y"], 5).collect()}
    b = {r["id"]: (r["x"], r["y"]) for r in permuted(df.repartition(3, "y"), ["x", "y"], 5).collect()}
    c = {r["id"]: (r["x"], r["y"]) for r in permuted(df, ["x", "y"], 6).collect()}
    assert a == b != c and all(x == -y for x, y in a.values())


def test_permutations_are_uniform(spark):
    """Each of the 24 orders of four rows comes as often as the others (chi-square, 23 degrees of freedom)."""
    ids = spark.range(4).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(1199))))
    hashed = ids.withColumn("h", F.xxhash64("seed", "id"))  # what permuted sorts by
    orders = hashed.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("h", "id"))).alias("o")).selectExpr("transform(o, x -> x.id) o").groupBy("o").count().collect()
    assert len(orders) == 24 and sum((r["count"] - 50) ** 2 / 50 for r in orders) < 49.7
    out = permuted(spark.range(4).withColumn("x", F.col("id")), ["x"], 17)
    want = [r[1] for r in sorted((r["h"], r["id"]) for r in hashed.where("seed = 17").collect())]
    assert [r["x"] for r in out.orderBy("id").collect()] == want


def brute(prices, events, pt, sl):
    out = []
    for k, t0, t1, trgt, side in events:
        p0 = [p for j, t, p in prices if j == k and t == t0]
        if not p0 or (t1 is not None and t1 < t0):
            continue
        times = {"sl": [], "pt": []}
        for start in p0:
            for j, t, p in sorted(prices, key=lambda r: r[1]):
                if j != k or t < t0 or (t1 is not None and t > t1) or p is None or p != p or not start or start != start or side is None:
                    continue
                move = (p / start - 1) * side
                if sl and move < -sl * trgt:
                    times["sl"].append(t)
                if pt and move > pt * trgt:
                    times["pt"].append(t)
        out.append((k, t0, t1, trgt, side, min(times["sl"], default=None), min(times["pt"], default=None)))
    return sorted(set(out), key=str)


@pytest.mark.parametrize(("bits", "pt", "sl"), [(1, 1.0, 2.0), (2, 1.5, 0.0), (7, 1.0, 1.0), (2, 0.0, 0.0)])
def test_barriers_equal_every_pair(spark, many_partitions, monkeypatch, bits, pt, sl):
    monkeypatch.setattr(crossing, "BITS", bits)
    rng = random.Random(bits)
    prices = []
    for k, n in ((1, 150), (2, 40), (3, 1), (4, 6)):
        x = 100.0
        for i in range(n):
            x += rng.gauss(0, 1)
            prices.append((k, at(i), rng.choice([x, x, x, x, x, x, None, float("nan"), -x if rng.random() < 0.1 else x])))
    prices += [(4, at(3), 50.0), (4, at(3), 200.0), (5, at(0), 0.0), (5, at(1), 3.0)]
    events = [(rng.choice([1, 1, 2, 3, 4, 5]), at(rng.randrange(60)), at(rng.choice([None, 5, 20, 59, 149])), rng.choice([0.005, 0.02, -0.01]), rng.choice([1.0, -1.0, 0.5, 0.0, None])) for _ in range(120)]
    p = spark.createDataFrame(prices, "series_id int, ts timestamp_ntz, close double")
    e = spark.createDataFrame(events, "series_id int, t0 timestamp_ntz, t1 timestamp_ntz, trgt double, side double")
    got = sorted((tuple(r) for r in labels.barrier_touches(p, e, pt, sl).collect()), key=str)
    assert got == brute(prices, events, pt, sl) and len(got) > 20


def test_open_ends_of_a_long_series_look_at_few_blocks(spark):
    """A rise that only the last row passes: every search climbs and comes down, and none walks the series."""
    n = 40_000
    path = spark.range(n).selectExpr("1 AS series_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts", f"CASE WHEN id = {n - 1} THEN 300D ELSE 100D + sin(id) END AS close")
    events = path.where("second(ts) % 20 = 0").selectExpr("series_id", "ts AS t0", "CAST(NULL AS timestamp_ntz) AS t1", "1D AS trgt", "1D AS side")
    out = labels.barrier_touches(path, events, 1.0, 1.0)
    last = T0 + dt.timedelta(seconds=n - 1)
    assert out.where(F.col("pt") == F.lit(last)).count() == out.count() == events.count() and out.where("sl is not null").count() == 0


def test_empty_paths_and_events(spark):
    p = spark.createDataFrame([], "series_id int, ts timestamp_ntz, close double")
    e = spark.createDataFrame([(1, T0, None, 0.1, 1.0)], "series_id int, t0 timestamp_ntz, t1 timestamp_ntz, trgt double, side double")
    assert labels.barrier_touches(p, e, 1, 1).count() == 0
    assert labels.barrier_touches(spark.createDataFrame([(1, T0, 5.0)], p.schema), e.where("false"), 1, 1).count() == 0


