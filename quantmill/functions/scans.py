"""Order-dependent columns and picks over series, by kernels on arrays instead of a step for each row.

A kernel takes a stretch of one series as NumPy arrays and the state that the rows before have
left, and gives its results and the state after it. Rows are dealt out by series and sorted, and
streamed through Arrow batches, so that a task holds one batch and one state.

With ``block_rows`` a series is dealt out too: rows are ranked by ranges (functions/ranks.py) and
cut into blocks. Each block first gives a summary (what it does to any state that comes in), the
summaries of a series are composed in order (one short row for each block), and every block then
runs with the state that comes in. That takes two passes over rows written in between, and pays
for series that are too long for one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import ranked, runs


class Kernel:
    """reads: the columns it takes. adds: the columns it gives; with none it picks rows."""

    reads: tuple[str, ...] = ()
    adds: tuple[str, ...] = ()

    def start(self) -> np.ndarray:
        """The state before the first row: a vector of numbers."""
        raise NotImplementedError

    def run(self, state: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The state after the rows, and an array for each of adds (or one of booleans). Missing values are NaN."""
        raise NotImplementedError

    def summary(self, *columns: np.ndarray) -> np.ndarray:
        """What the rows do to any state, as numbers; this and `after` are for series in blocks only."""
        raise NotImplementedError

    def after(self, state: np.ndarray, summary: np.ndarray) -> np.ndarray:
        """The state after rows of this summary."""
        raise NotImplementedError


def _floats(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)


def _stretches(batches, keys: Sequence[str], reads: Sequence[str]):
    """(batch, [(lo, hi, goes on from before)], arrays) of sorted batches; a stretch is the rows of one value of keys."""
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        bounds = np.unique(np.concatenate([runs(batch.column(k))[0] for k in keys])).tolist()
        name = lambda i, batch=batch: [batch.column(k)[i].as_py() for k in keys]
        goes_on = last is not None and name(0) == last
        last = name(batch.num_rows - 1)
        yield batch, [(lo, hi, lo == 0 and goes_on) for lo, hi in zip(bounds, bounds[1:], strict=False)], [_floats(batch.column(c)) for c in reads]


def _scanned(df: DataFrame, keys: Sequence[str], kernel: Kernel, begins: str | None = None) -> DataFrame:
    """The kernel over sorted partitions; begins: a column with the state that each stretch begins with (null: the first)."""
    own = [f for f in df.schema.fields if f.name != begins]
    names = [f.name for f in own]
    schema = T.StructType([*own, *(T.StructField(n, T.DoubleType()) for n in kernel.adds)])

    def run(batches):
        state = None
        for batch, found, columns in _stretches(batches, keys, kernel.reads):
            parts = []
            for lo, hi, goes_on in found:
                if not goes_on:
                    given = batch.column(begins)[lo].as_py() if begins else None
                    state = kernel.start() if given is None else np.array(given)
                state, out = kernel.run(state, *(c[lo:hi] for c in columns))
                parts.append(out)
            rows = batch.select(names)
            results = [np.concatenate(x) for x in zip(*parts, strict=True)]
            if not kernel.adds:
                yield rows.filter(pa.array(results[0]))
                continue
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(x, pa.float64(), from_pandas=True) for x in results)], [*names, *kernel.adds])

    return df.mapInArrow(run, schema)


def scan(df: DataFrame, key: str, order: Sequence[str], kernel: Kernel, block_rows: int | None = None) -> DataFrame:
    """The rows with the columns that the kernel adds, or those that it picks.

    block_rows: cut each series into blocks of so many rows (None: a series stays in one task).
    """
    if block_rows is None:
        return _scanned(df.repartition(F.col(key)).sortWithinPartitions(key, *order), [key], kernel)
    keys = [key, "_block"]
    placed = ranked(df, key, order).withColumn("_block", F.floor(F.col("_rank") / block_rows))
    dealt = lambda rows: rows.repartition(*keys).sortWithinPartitions(*keys, "_rank")
    name = [T.StructField(key, df.schema[key].dataType), T.StructField("_block", T.LongType())]

    def summed(batches):
        piece = 0  # a block that goes on from one batch to the next gives several summaries
        for batch, found, columns in _stretches(batches, keys, kernel.reads):
            at, pieces, made = [], [], []
            for lo, hi, goes_on in found:
                piece = piece + 1 if goes_on else 0
                at.append(lo)
                pieces.append(piece)
                made.append(kernel.summary(*(c[lo:hi] for c in columns)))
            rows = batch.select(keys).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(pieces, pa.int64()), pa.array(made, pa.list_(pa.float64()))], [*keys, "_piece", "_summary"])

    def composed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_block", "ascending"), ("_piece", "ascending")])
        state, at, states = kernel.start(), [], []
        for i, (piece, summary) in enumerate(zip(table.column("_piece").to_pylist(), table.column("_summary"), strict=True)):
            if piece == 0:
                at.append(i)
                states.append(state)
            state = kernel.after(state, np.array(summary.as_py(), float))
        rows = table.select(keys).take(pa.array(at))
        return pa.table([*rows.columns, pa.array(states, pa.list_(pa.float64()))], names=[*keys, "_state"])

    reads = [c for c in dict.fromkeys(kernel.reads) if c != key]
    numbers = T.ArrayType(T.DoubleType())
    summaries = dealt(placed.select(*keys, "_rank", *reads)).mapInArrow(summed, T.StructType([*name, T.StructField("_piece", T.LongType()), T.StructField("_summary", numbers)]))
    states = summaries.groupBy(key).applyInArrow(composed, T.StructType([*name, T.StructField("_state", numbers)])).toDF("_key", "_b", "_state")
    # the state, which may be long, goes with the first row of its block only
    begun = placed.join(states, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_rank") == F.col("_b") * block_rows), "left").drop("_key", "_b")
    return _scanned(dealt(begun), keys, kernel, "_state").drop("_rank", "_block")


class Decay(Kernel):
    """Exponentially weighted mean and deviation, adjusted and debiased; weights decay over missing values too.

    State: weight, weight of squares, mean, weighted sum of squares about the mean. Rows go in
    chunks in which powers of the decay stay within the range of numbers; in a chunk the
    recurrences are cumulative sums, about the mean that came in.
    """

    def __init__(self, column: str, span: float, mean: str | None = None, std: str | None = None):
        if span <= 0:
            raise ValueError("span must be positive")
        self.reads, self.adds, self.mean, self.std = (column,), tuple(n for n in (mean, std) if n), mean, std
        self.keep = 1 - 2 / (span + 1)
        self.chunk = 512 if self.keep <= 0 else max(1, min(512, int(60 / max(1e-9, -np.log10(self.keep)))))

    def start(self) -> np.ndarray:
        return np.zeros(4)

    def _chunk(self, state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        w0, v0, mean0, s0 = state
        there = ~np.isnan(x)
        about = mean0 if w0 > 0 else (x[there][0] if there.any() else 0.0)
        y = np.where(there, x - about, 0.0)
        decay = self.keep ** np.arange(1, len(x) + 1) if self.keep > 0 else np.zeros(len(x))
        grown = self.keep ** -np.arange(1, len(x) + 1.0) if self.keep > 0 else np.ones(len(x))
        total = lambda v, d, g, before: d * before + d * np.cumsum(v * g) if self.keep > 0 else v
        one = there.astype(float)
        w, v = total(one, decay, grown, w0), total(one, decay * decay, grown * grown, v0)
        first, second = total(y, decay, grown, 0.0), total(y * y, decay, grown, s0)
        shift = np.divide(first, w, out=np.zeros(len(x)), where=w > 0)
        return np.array([w[-1], v[-1], about + shift[-1], max(second[-1] - first[-1] * shift[-1], 0.0)]), [w, v, about + shift, np.maximum(second - first * shift, 0.0)]

    def _states(self, state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        parts = []
        for lo in range(0, len(x), self.chunk):
            state, out = self._chunk(state, x[lo : lo + self.chunk])
            parts.append(out)
        return state, [np.concatenate(p) for p in zip(*parts, strict=True)]

    def run(self, state, x):
        state, (w, v, mean, s) = self._states(state, x)
        rest = w * w - v
        with np.errstate(invalid="ignore", divide="ignore"):
            out = {self.mean: np.where(w > 0, mean, np.nan), self.std: np.where(rest > 1e-12, np.sqrt(s / w * w * w / rest), np.nan)}
        return state, [out[n] for n in self.adds]

    def summary(self, x):
        return np.concatenate([[self.keep ** len(x) if self.keep > 0 else 0.0], self._states(self.start(), x)[0]])

    def after(self, state, summary):
        decay, (w, v, mean, s) = summary[0], summary[1:]
        w0, v0, s0 = state[0] * decay, state[1] * decay * decay, state[3] * decay
        both = w0 + w
        gap = mean - state[2]
        return np.array([both, v0 + v, (w0 * state[2] + w * mean) / both if both > 0 else 0.0, s0 + s + (w0 * w / both * gap * gap if both > 0 else 0.0)])


class Filling(Kernel):
    """Picks the rows at which the running sum reaches the threshold; then it restarts at 0 and what overshoots is discarded.

    The row that ends a bar which begins after row i is a search in the sums; these links are
    followed from the first end by doubling them. Sums of whole numbers are exact; where a sum is too
    close to the threshold to be sure, or a value is negative, a stretch is added up row by row.

    State: the sum so far. A block does this to it: there is a first end for each sum that comes in, and
    what is left after the last end that follows. Only the rows up to the first end for a sum of 0 can be
    first ends, so that a summary is as long as one bar: their values, and what is left for each. What
    comes in is added to these values one by one, as is what is left, so that the state of a block is that
    of a walk over all rows before it, to the last bit.
    """

    def __init__(self, column: str, threshold: float):
        if threshold <= 0:
            raise ValueError("threshold must be positive")
        self.reads, self.threshold = (column,), float(threshold)

    def start(self) -> np.ndarray:
        return np.zeros(1)

    def _plain(self, s: float, x: np.ndarray) -> tuple[float, np.ndarray]:
        ends = np.zeros(len(x), bool)
        for i, value in enumerate(x.tolist()):
            s += value
            if s >= self.threshold:
                ends[i], s = True, 0.0
        return s, ends

    def _links(self, sums: np.ndarray) -> np.ndarray:
        """For each row the row that ends the bar which begins after it (the number of rows: none)."""
        return np.append(np.searchsorted(sums, sums + self.threshold, side="left"), len(sums))

    @staticmethod
    def _room(sums: np.ndarray) -> float:
        """More than a difference of these sums can be off by rounding."""
        return 4 * len(sums) * np.finfo(float).eps * max(1.0, float(sums[-1]))

    def _end_after(self, x: np.ndarray, i: int, guess: int) -> int:
        """The row that ends the bar which begins after row i, added up row by row; guess: about where it is."""
        upto = guess + 2
        while True:
            ends = np.flatnonzero(np.add.accumulate(x[i + 1 : upto]) >= self.threshold)
            if len(ends):
                return i + 1 + int(ends[0])
            if upto >= len(x):
                return len(x)
            upto += upto - i

    def _sure_links(self, x: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """The links, of bars that end too close to the threshold by adding up."""
        links, n = self._links(sums), len(x)
        if sums[-1] < 2**52 and (x == np.floor(x)).all():
            return links
        near = lambda at: np.abs(sums[at] - sums - self.threshold) < self._room(sums)
        at = links[:n]
        for i in np.flatnonzero(near(np.minimum(at, n - 1)) | near(np.maximum(at - 1, 0))).tolist():
            links[i] = self._end_after(x, i, int(at[i]))
        return links

    def run(self, state, x):
        x = np.nan_to_num(x, nan=0.0)
        s = float(state[0])
        if len(x) < 64 or (x < 0).any() or not np.isfinite(x).all():
            s, ends = self._plain(s, x)
            return np.array([s]), [ends]
        sums = np.cumsum(x)
        n = len(x)
        first = int(np.searchsorted(sums, self.threshold - s, side="left"))
        links = self._links(sums)
        at = np.array([first] if first < n else [], np.int64)
        jump = links
        while len(at) and at[-1] < n:  # rows reached so far, then those as many bars further
            more = jump[at]
            at = np.concatenate([at, more[more < n]])
            if (more >= n).any():
                break
            jump = jump[jump]
        before = np.concatenate([[-s], sums[at[:-1]]]) if len(at) else np.zeros(0)
        whole = float(s).is_integer() and sums[-1] < 2**52 and (x == np.floor(x)).all()
        if not whole:
            room = self._room(sums)
            reached, missed = sums[at] - before, sums[at] - x[at] - before
            last = sums[-1] - (sums[at[-1]] if len(at) else -s)
            if (np.abs(reached - self.threshold) < room).any() or (np.abs(missed - self.threshold) < room).any() or abs(last - self.threshold) < room:
                s, ends = self._plain(s, x)
                return np.array([s]), [ends]
        ends = np.zeros(n, bool)
        ends[at] = True
        rest = x[at[-1] + 1 :] if len(at) else np.concatenate([[s], x])
        return np.array([np.add.accumulate(rest)[-1] if len(rest) else 0.0]), [ends]

    def summary(self, x):
        x = np.nan_to_num(x, nan=0.0)
        if (x < 0).any() or not np.isfinite(x).all():
            raise ValueError("series in blocks need finite values that are not negative")
        sums = np.cumsum(x)
        n = len(x)
        first = int(np.searchsorted(sums, self.threshold, side="left"))
        starts = np.arange(min(first + 1, n))
        last, links = starts, self._sure_links(x, sums)
        tables = [links]
        while (tables[-1][starts] < n).any():
            tables.append(tables[-1][tables[-1]])
        for jump in reversed(tables):
            last = np.where(jump[last] < n, jump[last], last)
        ends, which = np.unique(last, return_inverse=True)
        left = np.array([np.add.accumulate(x[e + 1 :])[-1] if e + 1 < n else 0.0 for e in ends.tolist()])
        return np.concatenate([x[starts], left[which]])

    def after(self, state, summary):
        values, left = summary[: len(summary) // 2], summary[len(summary) // 2 :]
        sums = np.add.accumulate(np.concatenate([state, values]))
        ends = np.flatnonzero(sums[1:] >= self.threshold)
        return np.array([left[ends[0]] if len(ends) else sums[-1]])


def counts_below(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """How many of the ranks x[lo:hi] are below each bound: a wavelet matrix, one step a bit for all questions at once."""
    found, x = np.zeros(len(lo), np.int64), x.astype(np.int64)
    for bit in range(int(max(x.max(initial=0), bound.max(initial=0))).bit_length() - 1, -1, -1):
        one = (x >> bit) & 1
        zeros = np.concatenate([[0], np.cumsum(1 - one)])
        up = (bound >> bit) & 1 > 0
        a, b = zeros[lo], zeros[hi]
        found += np.where(up, b - a, 0)
        lo, hi = np.where(up, zeros[-1] + lo - a, a), np.where(up, zeros[-1] + hi - b, b)
        x = np.concatenate([x[one == 0], x[one == 1]])
    return found


class Percentile(Kernel):
    """Percentile (kind rank) of each value among the `before` values before it; missing until so many are there.

    State: the last values. Values must be there: rows without one go first.
    """

    def __init__(self, column: str, before: int, name: str):
        if before < 1:
            raise ValueError("a window needs values before its own")
        self.reads, self.adds, self.before = (column,), (name,), before

    def start(self) -> np.ndarray:
        return np.zeros(0)

    def after(self, state, summary):
        return np.concatenate([state, summary])[-self.before :]

    def summary(self, x):
        return x[-self.before :]

    def run(self, state, x):
        line = np.concatenate([state, x])
        _, rank = np.unique(line, return_inverse=True)
        own = np.arange(len(state), len(line))
        full = own >= self.before
        out = np.full(len(x), np.nan)
        at = own[full]
        less, upto = (counts_below(rank, at - self.before, at, rank[at] + more) for more in (0, 1))
        out[full] = (less + upto + (upto > less)) * 50.0 / self.before
        return self.after(state, x), [out]


class Running(Kernel):
    """The greatest value so far, the row's own included; missing before the first."""

    def __init__(self, column: str, name: str):
        self.reads, self.adds = (column,), (name,)

    def start(self) -> np.ndarray:
        return np.full(1, np.nan)

    def run(self, state, x):
        out = np.fmax.accumulate(np.concatenate([state, x]))[1:]
        return out[-1:] if len(out) else state, [out]

    def summary(self, x):
        return np.fmax.reduce(x, keepdims=True)

    def after(self, state, summary):
        return np.fmax(state, summary)
