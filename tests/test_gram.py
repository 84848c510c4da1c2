"""Sums of pairs by blocks against pandas over every pair."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from quantmill.functions import gram
from quantmill.operators import estimators

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def returns():
    rng = np.random.default_rng(7)
    x = rng.normal(5, 1, (40, 7)) @ rng.normal(size=(7, 7))
    x[rng.random(x.shape) < 0.15] = np.nan
    x[:, 6] = np.nan
    x[3, 6] = 1.0  # an asset with one time
    return pd.DataFrame(x, columns=list("abcdefg"), index=[T0 + dt.timedelta(days=i) for i in range(40)])


@pytest.fixture(params=[(128, 2048), (3, 16), (2, 7)])
def blocks(request, monkeypatch):
    monkeypatch.setattr(gram, "ASSETS", request.param[0])
    monkeypatch.setattr(gram, "TIMES", request.param[1])


def long(spark, frame):
    rows = [(t.to_pydatetime(), c, None if np.isnan(v) else float(v)) for c in frame for t, v in frame[c].items()]
    return spark.createDataFrame(rows, "ts timestamp_ntz, asset string, ret double").repartition(3)


def found(df):
    return {(r.asset_i, r.asset_j): r.cov for r in df.collect()}


def expected(frame, value):
    out = {}
    for i in frame:
        for j in frame:
            both = frame[[i]].assign(y=frame[j]).dropna()
            if len(both):
                out[i, j] = value(both[i].to_numpy(), both["y"].to_numpy())
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v, rel=1e-9, abs=1e-12)), k


def test_covariances(spark, returns, blocks):
    rets = long(spark, returns)
    same(found(estimators.sample_covariance(rets)), expected(returns, lambda x, y: np.cov(x, y)[0, 1] if len(x) > 1 else None))
    same(found(estimators.empirical_covariance(rets)), expected(returns, lambda x, y: np.cov(x, y, bias=True)[0, 1]))
    same(found(estimators.empirical_covariance(rets, centered=True)), expected(returns, lambda x, y: (x * y).mean()))
    low = lambda v: np.minimum(v - 2.0, 0)
    same(found(estimators.semi_covariance(rets, 2.0, by_assets=False)), expected(returns, lambda x, y: (low(x) * low(y)).mean()))


@pytest.mark.parametrize("whole", [True, False])
def test_exponential_covariance(spark, returns, blocks, whole):
    frame = returns[list("abcd")].dropna() if whole else returns

    def value(x, y):
        w = (1 - 2 / 11) ** np.arange(len(x) - 1, -1, -1.0)
        return (w * (x - x.mean()) * (y - y.mean())).sum() / w.sum()

    same(found(estimators.exponential_covariance(long(spark, frame), 10)), expected(frame, value))


def test_empty(spark, returns):
    assert estimators.sample_covariance(long(spark, returns).where("false")).count() == 0
