"""Closed forms, goldens and properties of the numerical operators."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantmill.functions import linalg, normal, roots
from quantmill.operators import backtest, features, garch, importance, mixture, options, reports, solvers
from quantmill.sources import generators


def test_normal(spark):
    xs = [-9.0, -3.0, -1e-9, 0.0, 0.5, 1.959963984540054, 6.5, None]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal.cdf(F.col("x")).alias("a"), F.expr(normal.cdf_sql("x")).alias("b")).collect()
    for r in got:
        want = None if r.x is None else NormalDist().cdf(max(min(r.x, 7), -7))
        assert r.a == (want if want is None else pytest.approx(want, abs=1e-14)) and (r.a == r.b or abs(r.a - r.b) < 1e-15)


def test_put_call_parity(spark):
    df = spark.createDataFrame([(100.0, 90.0, 0.5, 0.03, 0.2, 0.01)], "S double, K double, T double, r double, sigma double, q double")
    a = tuple(F.col(c) for c in ("S", "K", "T", "r", "sigma", "q"))
    c, p = df.select(options.price("c", *a, textbook=True), options.price("p", *a, textbook=True)).first()
    assert c - p == pytest.approx(100 * math.exp(-0.005) - 90 * math.exp(-0.015))
    with pytest.raises(ValueError):
        options.price("x", *a)


def test_fractional_differences(spark):
    x = np.cumsum(np.random.default_rng(0).normal(size=60))
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "series_id int, ts int, close double")
    get = lambda d, f: [r.frac_diff for r in f(df, d).orderBy("ts").collect()]
    assert get(0.0, features.frac_diff_ffd) == pytest.approx(list(x))
    assert get(1.0, features.frac_diff_ffd)[1:] == pytest.approx(list(np.diff(x)))
    w = features.weights(0.4, 60)
    got = get(0.4, features.frac_diff)
    assert got[0] is None and got[-1] == pytest.approx(float(np.dot(w[::-1], x)))
    assert features.weights_ffd(0.4, 0.01) == pytest.approx(w[: len(features.weights_ffd(0.4, 0.01))])


def test_roots():
    f, df = lambda x: 1 - x * math.exp(x), lambda x: -math.exp(x) * (1 + x)
    for path in (roots.bisect(f, 0, 2), roots.newton(f, df, 1.0), roots.secant(f, 0.0, second=2.0), roots.fixed_point(f, 1.0, 0.3), roots.steffensen(f, 1.0, 0.3)):
        assert path[-1] == pytest.approx(0.567143290409784, abs=1e-7)
    assert 1.8 < roots.order_of(roots.newton(f, df, 2.0, 1e-12)) < 2.2
    for bad in (lambda: roots.bisect(f, 1, 2), lambda: roots.newton(lambda x: 1.0, lambda x: 0.0, 0.0), lambda: roots.fixed_point(f, 1.0, 50.0)):
        with pytest.raises(roots.NoRoot):
            bad()


@pytest.fixture(scope="module")
def market():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(6, 6))
    return rng.normal(0.1, 0.05, 6), a @ a.T / 6 + 0.1 * np.eye(6)


def test_quadratic_programs(market):
    mean, cov = market
    b = solvers.bounds_of(6)
    w = solvers.min_volatility(cov, b)
    assert w.sum() == pytest.approx(1) and (w >= -1e-9).all()
    slope = 2 * cov @ w
    assert slope[w > 1e-6] == pytest.approx(np.full((w > 1e-6).sum(), slope[w > 1e-6].mean()), rel=1e-5) and (slope >= slope[w > 1e-6].mean() - 1e-6).all()
    line = solvers.CriticalLine(mean, cov)
    line.solve()
    assert line.min_variance() == pytest.approx(w, abs=1e-5)
    best = solvers.max_sharpe(mean, cov, 0.0, b)
    assert line.max_sharpe() == pytest.approx(best, abs=2e-3)
    target = float((w @ mean + mean.max()) / 2)
    assert solvers.for_return(mean, cov, target, b) @ mean == pytest.approx(target, abs=1e-7)
    risk = float(w @ cov @ w) * 1.3
    x = solvers.for_risk(mean, cov, risk, b)
    assert x @ cov @ x == pytest.approx(risk, rel=1e-4)
    assert solvers.custom(6, lambda v: float(v @ cov @ v), b) == pytest.approx(w, abs=1e-3)
    for s in solvers.SOLUTIONS:
        out = solvers.solve(s, mean, cov, target_return=target, target_risk=risk)
        assert out["weights"].sum() == pytest.approx(1, abs=1e-6) and (out["weights"] >= 0).all()
    with pytest.raises(ValueError):
        solvers.for_return(mean, cov, 9.0, b)
    with pytest.raises(ValueError):
        solvers.bounds_of(3, 0.0, 0.2)


def test_diagonal_cases():
    cov = np.diag([1.0, 2.0, 4.0])
    iv = (1 / np.diag(cov)) / (1 / np.diag(cov)).sum()
    assert solvers.min_volatility(cov, solvers.bounds_of(3)) == pytest.approx(iv, abs=1e-6)
    assert solvers.convex(cov) == pytest.approx(iv) and solvers.hierarchical(cov[:2, :2]) == pytest.approx([2 / 3, 1 / 3])
    assert solvers.nested(cov) == pytest.approx(iv)
    for m in solvers.METHODS:
        assert solvers.hierarchical(cov, m).sum() == pytest.approx(1)


def test_denoising_and_robust_covariance():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 20)) @ (np.eye(20) + 0.3)
    c = solvers.denoised(np.cov(x, rowvar=False), 100.0, 0.05)
    assert np.diag(c) == pytest.approx(np.diag(np.cov(x, rowvar=False))) and np.linalg.eigvalsh(c).min() > 0
    x[:200] += 50
    assert np.trace(solvers.min_determinant(x, 0.7)) < np.trace(np.cov(x, rowvar=False)) / 10


def test_mixture_moments_and_fit(spark):
    true = (-2.0, 1.0, 2.0, 1.0, 0.1)
    moments = mixture.mixture_moments(true)
    assert moments[:2] == pytest.approx([0.7, 2.6])
    assert mixture.central_moment(moments, 2) == pytest.approx(2.6 - 0.49)
    fits = mixture.fit_moments(spark, moments, n_run=3, starts=60, epsilon=1e-4)
    assert 1 <= fits.count() <= 3 and fits.agg(F.min("err")).first()[0] < 0.01 * sum(m * m for m in moments)


def test_unit_root_kernels():
    rng = np.random.default_rng(1)
    noise, walk = rng.normal(size=500), np.cumsum(rng.normal(size=500))
    assert linalg.adf(noise)[1] < 0.01 and linalg.adf(walk)[1] > 0.05
    assert linalg.kpss(walk)[1] <= 0.05
    rejected = [linalg.kpss(np.random.default_rng(100 + i).normal(size=300))[1] < 0.05 for i in range(60)]
    assert np.mean(rejected) < 0.15
    assert linalg.adf(noise)[3] == pytest.approx(-2.8673, abs=2e-3)
    assert linalg.shapiro(noise)[1] > 0.01 and linalg.shapiro(rng.exponential(size=500))[1] < 1e-6


def test_garch_finds_persistence():
    rng = np.random.default_rng(3)
    h, x = 1.0, []
    for _ in range(1500):
        e = math.sqrt(h) * rng.normal()
        x.append(e)
        h = 0.1 + 0.1 * e * e + 0.8 * h
    _, omega, a, b, _, forecast = garch.fit(np.array(x))
    assert 0.75 < a + b < 1 and a == pytest.approx(0.1, abs=0.06) and forecast > 0


def test_sharpe_probabilities(spark):
    one = spark.range(1)
    lit = lambda x: F.lit(float(x))
    same, larger = one.select(backtest.probabilistic_sharpe(lit(0.1), lit(0.1), lit(100), lit(0), lit(3)), backtest.min_track_record(lit(0.2), lit(0.1), lit(0), lit(3))).first()
    assert same == pytest.approx(0.5) and larger == pytest.approx(1 + (1 + 0.02) * (1.6448536269514722 / 0.1) ** 2)


def test_monte_carlo_rules(spark):
    r = backtest.binomial_sharpe(spark, p=0.5, n_run=4000).first()
    assert abs(r.mean) < 0.02 and r.std == pytest.approx(1 / math.sqrt(52), rel=0.1)
    nodes = backtest.trading_rules(spark, profits=[1, 5], losses=[1], forecasts=[5, -5], half_lives=[5])
    assert nodes.count() == 4 and nodes.where("forecast = 5").agg(F.min("mean")).first()[0] > nodes.where("forecast = -5").agg(F.max("mean")).first()[0]
    assert backtest.strategy_failure(spark, -0.1, 0.05, 0.05, 0.01, 0.5, 5000, 52, 2.0).first().discard


def test_reports(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1)], "series_id int, actual int, predicted int")
    got = {r.label: r for r in reports.classification_report(df).collect()}
    assert (got[1].precision, got[1].recall, got[1].accuracy, got[1].support) == (pytest.approx(2 / 3), pytest.approx(2 / 3), pytest.approx(0.6), 3)
    assert reports.confusion(df, predicted=None).where("predicted = 1").agg(F.sum("n")).first()[0] == 5


def test_rank_agreement():
    x, rank = np.array([0.55, 0.33, 0.07, 0.05]), np.array([1.0, 2.0, 4.0, 3.0])
    assert importance.kendall(x, 1 / rank) == pytest.approx(2 / 3)
    assert importance.weighted_kendall(x, rank) == pytest.approx(0.8133333, abs=1e-6)
    values, vectors = importance.eigenvectors(np.array([[1.0, 0.9], [0.9, 1.0]]), 0.9)
    assert values == pytest.approx([1.9]) and abs(vectors[0, 0]) == pytest.approx(0.5**0.5)


def test_generators(spark):
    x = generators.classification_set(spark, 6, 2, 2, 500)
    assert x.count() == 500 and {"I_0", "R_1", "N_1", "bin", "w", "t1"} <= set(x.columns)
    assert generators.price_walk(spark, n_samples=100, series=2).groupBy("series_id").count().where("count = 100").count() == 2
    assert generators.random_intervals(spark, 100).where("t1 <= t0 or dayofweek(t0) in (1, 7)").count() == 0
    assert generators.portfolio(spark, 200).where("label = int(open < 200)").count() == 200
    assert generators.correlated_returns(spark, 50).count() == 500
    with pytest.raises(ValueError):
        generators.classification_set(spark, 3, 2, 2)


def test_shapiro_takes_all_values(spark):
    from quantmill.operators import reports

    x = np.random.default_rng(4).normal(size=6001)
    x[1::2] = np.abs(x[1::2]) ** 3
    rows = [("long", i, float(v)) for i, v in enumerate(x)] + [("short", i, float(v)) for i, v in enumerate(x[:500])]
    df = spark.createDataFrame(rows, "series_id string, ts int, ret double")
    got = {r.series_id: r for r in reports.shapiro_wilk(df).collect()}
    assert (got["long"].w, got["long"].p_value) == linalg.shapiro(x) and not got["long"].p_in_range
    assert (got["short"].w, got["short"].p_value) == linalg.shapiro(x[:500]) and got["short"].p_in_range
    assert {r.series_id: (r.shapiro_w, r.shapiro_in_range) for r in reports.normality(df).collect()} == {k: (r.w, r.p_in_range) for k, r in got.items()}


def test_linkage_equals_a_plain_loop():
    rng = np.random.default_rng(8)
    for method in solvers.METHODS:
        x = rng.normal(size=(25, 3))
        squared = method in ("centroid", "ward")
        d = {(i, j): float(((x[i] - x[j]) ** 2).sum()) ** (1 if squared else 0.5) for i in range(25) for j in range(i + 1, 25)}
        size, alive, expected = dict.fromkeys(range(25), 1), list(range(25)), []
        for new in range(25, 49):
            i, j = min(((a, b) for k, a in enumerate(alive) for b in alive[k + 1 :]), key=d.get)
            dij, ni, nj = d[i, j], size[i], size[j]
            alive = [c for c in alive if c not in (i, j)]
            for k in alive:
                a, b, nk = d[min(i, k), max(i, k)], d[min(j, k), max(j, k)], size[k]
                d[k, new] = {
                    "single": min(a, b), "average": (ni * a + nj * b) / (ni + nj), "weighted": (a + b) / 2, "centroid": (ni * a + nj * b) / (ni + nj) - ni * nj * dij / (ni + nj) ** 2, "ward": ((ni + nk) * a + (nj + nk) * b - nk * dij) / (ni + nj + nk),
                }[method]
            size[new] = ni + nj
            alive.append(new)
            expected.append((i, j, dij**0.5 if squared else dij, ni + nj))
        got = solvers.linkage(x, method)
        assert [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in expected]
        assert np.allclose([x[2] for x in got], [x[2] for x in expected])


def test_robust_covariance_equals_the_solver_on_all_rows(spark):
    from quantmill.operators import allocation

    rng = np.random.default_rng(5)
    x = rng.multivariate_normal([0, 0, 0], [[1, 0.5, 0], [0.5, 1, 0], [0, 0, 2]], 300)
    x[:40] += 50
    import datetime

    rows = [(datetime.datetime(2020, 1, 1) + datetime.timedelta(days=i), f"a{k}", float(v)) for i, r in enumerate(x) for k, v in enumerate(r)]
    got = allocation.robust_covariance(spark.createDataFrame(rows, "ts timestamp_ntz, asset string, ret double"))
    c = np.zeros((3, 3))
    for r in got.collect():
        c[int(r.asset_i[1]), int(r.asset_j[1])] = r.cov
    best = solvers.min_determinant(x)
    assert abs(np.linalg.slogdet(c)[1] - np.linalg.slogdet(best)[1]) < 0.05 and np.trace(c) < np.trace(np.cov(x, rowvar=False)) / 10


def test_draws_are_the_same_in_any_partitioning(spark):
    from quantmill.functions.draws import normal, uniform

    rows = lambda n: spark.range(0, 4000, 1, n).select("id", uniform(1, 2).alias("u"), normal(1, 3).alias("z")).orderBy("id").collect()
    a, b = rows(1), rows(7)
    z, u = np.array([r.z for r in a]), np.array([r.u for r in a])
    assert a == b and abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.05 and abs(u.mean() - 0.5) < 0.02 and 0 < u.min() and u.max() < 1
