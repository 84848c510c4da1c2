"""Sums of amounts in cents meet the threshold: blocks must add as a walk over the rows does."""

import numpy as np
import pytest

from quantmill.functions.scans import Filling


def walk(x, threshold):
    s, ends = 0.0, []
    for i, v in enumerate(x.tolist()):
        s += v
        if s >= threshold:
            ends.append(i)
            s = 0.0
    return s, ends


def by_blocks(x, threshold, block):
    kernel = Filling("x", threshold)
    state, ends = kernel.start(), []
    for lo in range(0, len(x), block):
        part = x[lo : lo + block]
        after, picked = kernel.run(state, part)
        ends += (lo + np.flatnonzero(picked[0])).tolist()
        composed = kernel.after(state, kernel.summary(part))
        assert composed[0] == after[0]
        state = composed
    return float(state[0]), ends


@pytest.mark.parametrize("block", [7, 100, 512])
@pytest.mark.parametrize("make", [
    lambda r: np.round(r.exponential(50, 30_000), 2), lambda r: np.round(r.exponential(0.3, 30_000), 1), lambda r: np.full(6_000, 0.1),
    lambda r: r.integers(0, 3, 6_000).astype(float), lambda r: np.where(r.random(6_000) < 0.7, 0.0, np.round(r.exponential(2, 6_000), 1)), lambda r: r.random(6_000) * 1e-3,
])
def test_blocks_end_where_a_walk_does(block, make):
    x = make(np.random.default_rng(block))
    threshold = 500.0 if x.max() > 100 else 3.0
    assert by_blocks(x, threshold, block) == walk(x, threshold)
