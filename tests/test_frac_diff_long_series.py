"""The query frac_diff on series longer than a block: no task holds a series, and the rows stay the same."""

import datetime

import numpy as np
import pytest

from quantmill.operators import features
from quantmill.plans import allocations

BLOCK = 1 << 14


def by_loop(values, d, threshold):
    """Sums over all values so far, one row at a time; a gap takes the value before it and has no result."""
    line = np.array([np.nan if v is None else v for v in values])
    if np.isnan(line).all():
        return [None] * len(line)
    lead = int(np.isnan(line).argmin())
    x = line[lead:].copy()
    for t in range(1, len(x)):
        x[t] = x[t - 1] if np.isnan(x[t]) else x[t]
    w = np.array(features.weights(d, len(x)))
    share = np.cumsum(np.abs(w[::-1]))
    skip = int((share / share[-1] > threshold).sum())
    return [None if t < lead + skip or np.isnan(line[t]) else float(w[: t - lead + 1] @ x[t - lead :: -1]) for t in range(len(line))]


def test_query_holds_no_series_in_a_task(spark, tmp_path, monkeypatch):
    def short_only(x, *more):
        if len(x) > BLOCK:
            raise MemoryError(f"{len(x)} rows of a series in one task")
        return real(x, *more)

    real = features.expanding_diff
    n = 2 * BLOCK + 5000
    start = datetime.datetime(2024, 1, 1)
    draw = np.random.default_rng(3)
    values = 100 + 50 * draw.random(n)
    rows = [(i, start + datetime.timedelta(seconds=i), "long", float(v)) for i, v in enumerate(values)] + [(n + i, start + datetime.timedelta(seconds=i), "short", float(i % 7)) for i in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(features, "expanding_diff", short_only)
    got = {(r.series_id, r.ts): r.frac_diff for r in allocations.frac_diff(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    w = np.array(features.weights(0.4, n))
    skip = n - int(np.searchsorted(np.cumsum(np.abs(w[::-1])), 0.01 * np.abs(w).sum(), side="right"))
    for t in (0, skip - 1, skip, BLOCK - 1, BLOCK, 2 * BLOCK - 1, 2 * BLOCK, 2 * BLOCK + 1, n - 1):
        found = got["long", start + datetime.timedelta(seconds=t)]
        assert (found is None) == (t < skip), t
        assert found is None or found == pytest.approx(float(w[: t + 1] @ values[t::-1]), abs=2e-6), t
    assert [got["short", start + datetime.timedelta(seconds=i)] for i in range(300)] == [None if v is None else pytest.approx(v, abs=2e-6) for v in by_loop([float(i % 7) for i in range(300)], 0.4, 0.01)]


def test_gaps_longer_than_blocks(spark):
    draw = np.random.default_rng(5)
    x = [float(v) for v in 10 + draw.random(90)]
    series = {"lead": [None] * 19 + x[19:], "gap": x[:10] + [None] * 30 + x[40:], "end": x[:60] + [None] * 25, "none": [None] * 40, "one": [None] * 30 + [2.0], None: x}
    rows = [(k, t, v) for k, values in series.items() for t, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series_id string, ts int, close double").repartition(3)
    for d in (0.4, 0.0, 1.3):
        got = {(r.series_id, r.ts): r.frac_diff for r in features.frac_diff(df, d, 0.2, block_rows=8).collect()}
        assert len(got) == len(rows)
        for k, values in series.items():
            assert [got[k, t] for t in range(len(values))] == [None if v is None else pytest.approx(v, abs=1e-9) for v in by_loop(values, d, 0.2)], (k, d)


def test_rows_grow_with_the_series(spark):
    """No block is copied for each block after it."""
    df = spark.range(64).selectExpr("1 AS series_id", "id AS ts", "id * 1.0D AS close")
    plan = features.frac_diff(df, 0.4, block_rows=8)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.lower() and "generate" not in plan.lower()


@pytest.mark.parametrize(("d", "n"), [(0.4, 1), (0.4, 64), (0.4, 65), (1.0, 40), (0.7, 200)])
def test_rows_left_out_from_blocks_known(d, n):
    known = features._weight_blocks(d, 200, 16)
    assert features._left_out(d, n, 0.01, 16, known) == features._left_out(d, n, 0.01)
