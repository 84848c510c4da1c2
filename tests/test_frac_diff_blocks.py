"""Fractional differences by blocks against those of whole series."""

import random

import numpy as np
import pytest

from quantmill.operators import features


@pytest.mark.parametrize(("d", "n", "threshold"), [(0.4, 1, 0.01), (0.4, 50, 0.01), (0.7, 300, 0.1), (1.0, 60, 0.01), (0.2, 97, 0.5), (0.0, 20, 0.01)])
def test_rows_left_out(d, n, threshold):
    w = np.array(features.weights(d, n))
    share = np.cumsum(np.abs(w[::-1]))
    want = int((share / share[-1] > threshold).sum())
    assert all(features._left_out(d, n, threshold, chunk) == want for chunk in (1, 7, 50, 1 << 20))


def test_weights_from_any_place():
    w = features.weights(0.35, 200)
    assert features._weights_from(w[120], 120, 0.35, 80).tolist() == pytest.approx(w[120:]) and features._weights_from(1.0, 0, 0.35, 1).tolist() == [1.0]


@pytest.mark.parametrize(("size", "products"), [(16, 3), (64, 64)])
def test_blocks_equal_whole_series(spark, monkeypatch, size, products):
    monkeypatch.setattr(features, "PRODUCTS", products)
    rng = random.Random(size)
    rows = [(k, i, rng.choice([None, 100 + rng.random()]) if i < 3 or rng.random() < 0.1 else 100 + rng.random(), f"r{i}") for k, n in ((None, 40), (1, 500), (2, 16), (3, 1)) for i in range(n)]
    rows += [(4, 0, None, "none")]
    df = spark.createDataFrame(rows, "series_id int, ts int, close double, other string").repartition(3)
    for d in (0.4, 1.0):
        whole, blocks = (features.frac_diff(df, d, 0.05, block_rows=b) for b in (None, size))
        assert whole.columns == blocks.columns
        a, b = ({(r.series_id, r.ts): r for r in x.collect()} for x in (whole, blocks))
        assert a.keys() == b.keys() and len(a) == len(rows)
        for k, r in a.items():
            assert r.other == b[k].other and (r.frac_diff is None) == (b[k].frac_diff is None), k
            assert r.frac_diff is None or r.frac_diff == pytest.approx(b[k].frac_diff, abs=1e-9)
    assert features.frac_diff(df.where("false"), 0.4, block_rows=size).count() == 0
