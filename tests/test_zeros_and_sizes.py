"""Prices of zero as SQL has them, and what must hold on large tables."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantmill.operators import bootstrap, crossval, filters, garch, importance, labels
from quantmill.operators.ensemble import SequentialBagging

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("seed", [50, 109, 111])
def test_garch_far_from_its_start(seed):
    """Noise without persistence leads the search to parameters whose exponentials overflow."""
    out = garch.fit(np.random.default_rng(seed).normal(0, 1, 29) * 10)
    assert all(math.isfinite(v) for v in out) and out[2] + out[3] < 1


def test_garch_leaves_out_infinite_returns():
    x = np.random.default_rng(7).normal(0, 1, 200)
    assert garch.fit(np.insert(x, [3, 90], [math.inf, -math.inf])) == garch.fit(x)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().lower()


def test_no_fill_reads_the_rest_of_a_series_for_each_row(spark):
    prices = spark.createDataFrame([(1, T0 + dt.timedelta(hours=h), float(h)) for h in range(60)], "series_id int, ts timestamp_ntz, close double")
    events = labels.vertical_barrier(prices, prices.selectExpr("series_id", "ts AS t0"))
    assert {(r.t1 - r.t0) for r in events.collect()} == {dt.timedelta(days=1)} and events.count() == 36
    out = labels.meta_label(prices, events)
    assert out.where("abs(ret - try_divide(24, (unix_micros(CAST(t0 AS timestamp)) - unix_micros(timestamp'2024-01-01')) / 3600e6)) < 1e-12").count() == 35  # not the first, whose price is 0: its return is infinite
    for df in (events, out):
        assert "unboundedfollowing" not in plan(df)


def test_monte_carlo_runs_do_not_depend_on_their_groups(spark, monkeypatch):
    bars = spark.range(300).selectExpr("id % 3 AS series_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS int)) AS ts")
    events = bars.selectExpr("series_id", "ts AS t0", "ts + interval 7 hours AS t1")
    runs = lambda: {tuple(r) for r in bootstrap.monte_carlo_by_series(bars, events, 10, 11).collect()}
    got = runs()
    assert len(got) == 33 and {r[1] for r in got} == set(range(11))
    monkeypatch.setattr(bootstrap, "RUNS_AT_ONCE", 1)
    assert runs() == got


def test_draws_at_times_that_pandas_does_not_hold(spark):
    """Rows of 120,000 days reach the year 2348; nanoseconds end in 2262."""
    rows = spark.range(1500).selectExpr("id * 80 AS id", "timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(CAST(id * 80 AS int)) AS t0", "CAST(id % 2 AS double) AS label", "CAST(id AS double) AS f0").selectExpr("*", "t0 + interval 200 days AS t1", "1 AS series_id")
    bars = rows.select("series_id", F.col("t0").alias("ts"))
    model = SequentialBagging(["f0"], n_estimators=2, seed=1).fit(rows, bars)
    assert model.drawn.groupBy("m").agg(F.sum("n")).collect() and model.predict(rows).where("prediction is null").count() == 0
    drawn = bootstrap.sequential_bootstrap(bars, rows.withColumn("t1", F.when(F.col("id") != 80, F.col("t1"))), 1000)
    assert drawn.count() == 1000 and drawn.join(rows.select("t0"), "t0").count() == 1000
    assert drawn.where("t1 is null").where("t0 != timestamp_ntz'2020-03-21'").count() == 0
    assert drawn.where("t1 != t0 + interval 200 days").count() == 0


def test_projections_are_one_product_whatever_the_number_of_columns(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (60, 12)) @ rng.normal(0, 1, (12, 12))
    names = [f"f{i}" for i in range(12)]
    rows = [(i, *(None if (i, j) == (5, 3) else float(v) for j, v in enumerate(r))) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} double" for n in names))
    out = importance.orthogonal(df, names)
    assert len(plan(out)) < 4000
    stats, corr = importance._standard(df, names)
    _, vectors = importance.eigenvectors(corr)
    for r in out.collect():
        made = [r[f"PC_{k + 1}"] for k in range(vectors.shape[1])]
        if r.id == 5:
            assert made == [None] * len(made)
        else:
            z = np.array([(r[n] - stats[n][0]) / stats[n][1] for n in names])
            np.testing.assert_allclose(made, z @ vectors, atol=1e-9)


ZEROS = ("barrier_touches", "tri_barrier", "meta_label", "bekker_parkinson", "corwin_schultz", "dsr", "ewm_vol", "garman_klass_vol", "volatility_ranking", "yang_zhang_vol", "hhi", "imbalance_bars", "imbalance_check", "imbalance_signals", "simple_returns", "lagged_return", "return_weights", "cusum_events")


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    """Prices with zeros, sums at the limit of the filter and a return at a half of the sixth digit."""
    d, rng = tmp_path_factory.mktemp("zeros"), np.random.default_rng(5)
    rows = [(i, T0 + dt.timedelta(minutes=37 * i), i % 9, f"t{i % 2}", 0.0 if i in (100, 109, 400, 801) else round(float(rng.exponential(50)), 2)) for i in range(1200)]
    rows += [(2000 + i, T0 + dt.timedelta(hours=i), 50, "t0", v) for i, v in enumerate([25.6, 230.52, 25.59, 85.3, 1.1, 0.0, 0.0, 3.0])]
    # 0.1 + 50.2 - 0.3 is not below 50, 50.2 - 0.3 + 0.1 is, or the other way round
    rows += [(3000 + i, T0 + dt.timedelta(hours=i, seconds=1), 60 + i // 40, "t1", round(float(v), 1)) for i, v in enumerate(np.tile(rng.integers(0, 500, 40) / 10, 30))]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double").repartition(1).write.parquet(str(d / "all"))
    import shutil

    shutil.copy(next((d / "all").glob("part-*.parquet")), d / "events.parquet")
    return str(d)


@pytest.mark.parametrize("name", ZEROS)
def test_prices_of_zero_as_sql_has_them(spark, zeros, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    c = duckdb.connect()
    c.execute(f"SET TimeZone='UTC'; CREATE VIEW events AS SELECT * FROM '{zeros}/events.parquet'")
    df = entry.queries()[name](spark, zeros)
    expected = c.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    shown = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert shown(df.collect()) == shown(expected) and expected


def test_filter_adds_in_the_order_of_its_formula():
    """At the limit the last bit decides: u + value - last, not u + (value - last)."""
    rng = np.random.default_rng(1)
    values = [round(float(v), 2) for v in rng.exponential(50, 40_000)]
    state, fired, u, m, plain = [None, 0.0, 0.0], [], 0.0, 0.0, []
    for i, v in enumerate(values):
        fired.append(filters.cusum_step(state, v, 20.0))
        if i:
            u, m = max(0.0, u + v - values[i - 1]), min(0.0, m + v - values[i - 1])
        plain.append(u >= 20.0 or m <= -20.0)
        u, m = (0.0, m) if u >= 20.0 else (u, 0.0 if m <= -20.0 else m)
    assert fired == plain


def test_folds_meet_the_rows_once(spark, monkeypatch):
    """However many features and models there are, the rows are joined to their folds once and nothing is broadcast."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.tuning import ParamGridBuilder

    rows = spark.range(400).selectExpr("id", "CAST(id % 2 AS double) AS label", *(f"CAST((id % 2) * {i} + hash(id, {i}) % 7 AS double) AS f{i}" for i in range(5)), "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(CAST(id AS int)) AS t0").selectExpr("*", "t0 + interval 1 day AS t1", "1 AS series_id").cache()
    names, folds = [f"f{i}" for i in range(5)], crossval.purged_folds(rows, 2, ranges=True)
    tree, made = DecisionTreeClassifier(labelCol="label", featuresCol="features", maxDepth=2, seed=1), []
    kept = crossval.written
    monkeypatch.setattr(crossval, "written", lambda df, name: made.append((name, plan(df))) or kept(df, name))
    table = crossval.with_roles(rows, folds)
    whole = {(r.id, r.fold, r.role) for r in folds.collect()}
    assert {(r.id, k, role) for k in (0, 1) for role in ("train", "test") for r in crossval.in_fold(table, k, role).collect()} == whole
    made.clear()
    importance.sfi(tree, rows, names, folds)
    assert [n for n, _ in made] == ["folds"]
    crossval.hyper_fit(tree, ParamGridBuilder().addGrid(tree.maxDepth, [1, 2, 3]).build(), importance.assemble(rows, names), folds)
    crossval.cv_score(tree, importance.assemble(rows, names), folds)
    assert [n for n, _ in made] == ["folds"] * 3
    for _, p in made:  # the folds themselves join a few rows
        assert 0 < p.index("sortmergejoin") < (p.find("broadcasthashjoin") % (1 << 30))


def test_fourier_features_are_products_in_batches(spark):
    from quantmill.operators import kernel

    df = spark.createDataFrame([(i, float(i), float(-i)) for i in range(9)], "id int, x double, y double")
    out = kernel.fourier(df, ["x", "y"], 0.1, n=512)
    assert "aggregate(" not in plan(out) and out.count() == 9
    with pytest.raises(Exception, match="null"):
        kernel.fourier(df.withColumn("x", F.lit(None).cast("double")), ["x", "y"], 0.1, n=4).collect()
