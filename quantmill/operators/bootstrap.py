"""Sequential bootstrap and its Monte Carlo comparison.

Draws inside a run depend on one another, so runs are what is parallel: each run is a row
with its own seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import ranked
from ..functions.tables import written

#: Stands for an end that is open, in microseconds.
OPEN = 1 << 62


def micros(t: Column, missing: int | None = None) -> Column:
    """A time as microseconds: pandas holds times to the year 2262 only."""
    whole = F.unix_micros(t.cast("timestamp"))
    return whole if missing is None else F.coalesce(whole, F.lit(missing))


def spans(bar_ts: np.ndarray, t0: np.ndarray, t1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last bar of each event."""
    return np.searchsorted(bar_ts, t0, side="left"), np.searchsorted(bar_ts, t1, side="right")


def uniqueness(first: np.ndarray, past: np.ndarray, alive: np.ndarray, extra: int = 1) -> np.ndarray:
    """Mean of 1 / (alive + extra) over the bars of each event."""
    s = np.concatenate([[0.0], np.cumsum(1 / np.maximum(alive + extra, 1))])
    n = past - first
    return np.where(n > 0, (s[past] - s[first]) / np.maximum(n, 1), 0.0)


class Sums:
    """Numbers by place under changes, with the place at which their running sum passes a value: a binary indexed tree."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.values, self.top = values.tolist(), 1 << max(0, n.bit_length() - 1)
        before = np.concatenate([[0.0], np.cumsum(values)])
        at = np.arange(1, n + 1)
        self.tree = [0.0, *(before[at] - before[at - (at & -at)]).tolist()]

    def put(self, i: int, value: float) -> None:
        change = value - self.values[i]
        self.values[i] = value
        i += 1
        while i < len(self.tree):
            self.tree[i] += change
            i += i & -i

    def total(self) -> float:
        i, s = len(self.values), 0.0
        while i:
            s += self.tree[i]
            i -= i & -i
        return s

    def place(self, u: float) -> int:
        """The first place whose running sum is above u (at most the last one)."""
        i, step = 0, self.top
        while step:
            if i + step < len(self.tree) and self.tree[i + step] <= u:
                i += step
                u -= self.tree[i]
            step >>= 1
        return min(i, len(self.values) - 1)


class Alive:
    """How many drawn events hold each bar, by blocks with their least and greatest count.

    Sums of 1 / (count + 1) over bars are bounded by the blocks alone; where all events meet
    counts differ little inside a block, and the bounds are close.
    """

    BLOCK = 512

    def __init__(self, n_bars: int):
        n = -(-n_bars // self.BLOCK)
        self.count = np.zeros(n * self.BLOCK, np.int64)
        self.least, self.most = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.whole = np.zeros(n, np.int64)  # added to all bars of a block

    def add(self, lo: int, hi: int) -> None:
        size = self.BLOCK
        a, b = -(-lo // size), hi // size
        edges = [(lo, hi)] if a > b else [(lo, a * size), (b * size, hi)]
        if a < b:
            self.whole[a:b] += 1
            self.least[a:b] += 1
            self.most[a:b] += 1
        for x, y in edges:
            if x < y:
                k = x // size
                self.count[x:y] += 1
                block = self.count[k * size : (k + 1) * size]
                self.least[k], self.most[k] = block.min() + self.whole[k], block.max() + self.whole[k]

    def _part(self, lo: int, hi: int) -> float:
        k = lo // self.BLOCK
        return float((1 / (self.count[lo:hi] + (self.whole[k] + 1))).sum())

    def bounds(self, lo: int, hi: int) -> tuple[float, float]:
        """Bounds of the sum over the bars from lo on before hi."""
        size = self.BLOCK
        a, b = -(-lo // size), hi // size
        if a >= b:
            s = self.exact(lo, hi)
            return s, s
        edge = (self._part(lo, a * size) if lo < a * size else 0.0) + (self._part(b * size, hi) if b * size < hi else 0.0)
        return edge + float((size / (self.most[a:b] + 1)).sum()), edge + float((size / (self.least[a:b] + 1)).sum())

    def exact(self, lo: int, hi: int) -> float:
        size = self.BLOCK
        added = np.repeat(self.whole[lo // size : -(-hi // size)], size)[lo - lo // size * size :][: hi - lo]
        return float((1 / (self.count[lo:hi] + added + 1)).sum())


def sequential_draws(first: np.ndarray, past: np.ndarray, n_bars: int, size: int, rng: np.random.Generator) -> np.ndarray:
    """Draw with replacement, each time in proportion to the uniqueness given the draws so far: one uniform number a draw.

    What `lazy_draws` draws from too, by looking at every event that a draw meets.

    A draw changes the uniqueness of the events that meet it only: those are found by their first bar, and sums
    over blocks of events give the place of the next draw. Events that all meet cost one pass a draw.
    """
    n, block = len(first), 256
    alive, out = np.zeros(n_bars), np.zeros(size, np.int64)
    if not n:
        return out[:0]
    order = np.argsort(first, kind="stable")
    starts, longest = first[order], max(int((past - first).max()), 0)
    p = np.zeros(-(-n // block) * block)
    p[:n] = uniqueness(first, past, alive)
    blocks = p.reshape(-1, block)  # a view
    sums = blocks.sum(axis=1)
    for i in range(size):
        upto = np.cumsum(sums)
        if upto[-1] > 0:
            u = rng.random() * upto[-1]
            b = min(int(np.searchsorted(upto, u, side="right")), int(np.flatnonzero(sums)[-1]))
            inner = np.cumsum(blocks[b])
            k = min(int(np.searchsorted(inner, u - (upto[b] - sums[b]), side="right")), int(np.flatnonzero(blocks[b])[-1]))
            d = b * block + k
        else:
            d = int(rng.integers(n))
        out[i] = d
        if past[d] <= first[d]:
            continue
        alive[first[d] : past[d]] += 1
        near = order[np.searchsorted(starts, first[d] - longest, side="left") : np.searchsorted(starts, past[d], side="left")]
        low, high = int(first[near].min()), int(max(past[near].max(), first[near].max()))
        p[near] = uniqueness(first[near] - low, past[near] - low, alive[low:high])
        touched = np.unique(near // block)
        sums[touched] = blocks[touched].sum(axis=1)
    return out


def lazy_draws(first: np.ndarray, past: np.ndarray, n_bars: int, size: int, rng: np.random.Generator) -> np.ndarray:
    """Draw with replacement, each time in proportion to the uniqueness given the draws so far.

    Uniqueness only falls as draws come. So what it was when last looked at bounds it: an event is
    proposed in proportion to that and taken with the ratio of what it is to what it was, which
    gives the law of drawing in proportion to what it is; when refused, it is looked at anew. Only
    events that are proposed are looked at, and mostly by bounds over blocks of bars, so that events
    that all meet cost a few proposals a draw.
    """
    n = len(first)
    if not n:
        return np.zeros(0, np.int64)
    alive, out, bars = Alive(n_bars), np.zeros(size, np.int64), np.maximum(past - first, 0)
    known = Sums((bars > 0).astype(float))
    starts, ends, lengths = first.tolist(), past.tolist(), bars.tolist()
    some = bool((bars > 0).any())
    for i in range(size):
        if not some:  # no event holds a bar
            out[i] = rng.integers(n)
            continue
        while True:
            d = known.place(rng.random() * known.total())
            was = known.values[d] * lengths[d]
            if was <= 0:  # rounding led to an event without bars
                continue
            bar = rng.random() * was
            low, high = alive.bounds(starts[d], ends[d])
            if low <= bar < high:
                low = high = alive.exact(starts[d], ends[d])
            known.put(d, min(known.values[d], high / lengths[d]))
            if bar < low:
                break
        out[i] = d
        alive.add(starts[d], ends[d])
    return out


def sample_uniqueness(first: np.ndarray, past: np.ndarray, n_bars: int, draws: np.ndarray) -> float:
    """Mean uniqueness of a sample of events."""
    change = np.zeros(n_bars + 1)
    np.add.at(change, first[draws], 1)
    np.add.at(change, past[draws], -1)
    return float(uniqueness(first[draws], past[draws], np.cumsum(change)[:-1], 0).mean()) if len(draws) else float("nan")


def sequential_bootstrap(bars: DataFrame, events: DataFrame, sample_len: int | None = None, seed: int = 0, *, key: str = "series_id", ts: str = "ts") -> DataFrame:
    """Per series the drawn events in order: series, draw, t0, t1. Default length: all its events."""

    def run(_k, b: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if b.empty or e.empty:
            return pd.DataFrame({key: [], "draw": [], "t0": [], "t1": []})
        at = np.sort(b[ts].to_numpy())
        e = e.sort_values(["t0", "t1"])
        first, past = spans(at, e["t0"].to_numpy(), e["t1"].to_numpy())
        draws = lazy_draws(first, past, len(at), sample_len or len(e), np.random.default_rng([seed, len(e)]))
        return pd.DataFrame({key: e[key].iloc[0], "draw": np.arange(len(draws)), "t0": e["t0"].to_numpy()[draws], "t1": e["t1"].to_numpy()[draws]})

    kind = bars.schema[key].dataType.simpleString()
    at = bars.where(F.col(ts).isNotNull()).select(key, micros(F.col(ts)).alias(ts))
    numbers = events.select(key, micros(F.col("t0"), OPEN).alias("t0"), micros(F.col("t1"), OPEN).alias("t1"))
    drawn = at.groupBy(key).cogroup(numbers.groupBy(key)).applyInPandas(run, f"{key} {kind}, draw bigint, t0 bigint, t1 bigint")
    time = lambda c: F.when(F.col(c) != OPEN, F.timestamp_micros(c)).cast("timestamp_ntz").alias(c)
    return drawn.select(key, "draw", time("t0"), time("t1"))


def _compare(first: np.ndarray, past: np.ndarray, n_bars: int, size: int, rng: np.random.Generator) -> tuple[float, float]:
    standard = sample_uniqueness(first, past, n_bars, rng.integers(len(first), size=size))
    return standard, sample_uniqueness(first, past, n_bars, lazy_draws(first, past, n_bars, size, rng))


def monte_carlo(spark: SparkSession, bar_ts: np.ndarray, t0: np.ndarray, t1: np.ndarray, sample_len: int | None = None, iterations: int = 100, seed: int = 0) -> DataFrame:
    """Mean uniqueness of standard and sequential samples in each iteration: run, standard, sequential."""
    first, past = spans(np.sort(bar_ts), t0, t1)
    n = len(bar_ts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(int(i), *_compare(first, past, n, sample_len or len(first), np.random.default_rng([seed, i]))) for i in pdf["id"]]
            yield pd.DataFrame(rows, columns=["run", "standard", "sequential"])

    return spark.range(iterations).mapInPandas(run, "run bigint, standard double, sequential double")


#: Runs of a series that share one copy of it.
RUNS_AT_ONCE = 8


def monte_carlo_by_series(bars: DataFrame, events: DataFrame, sample_len: int | None = None, iterations: int = 100, seed: int = 0, *, key: str = "series_id", ts: str = "ts") -> DataFrame:
    """Mean uniqueness of standard and sequential samples of the events of each series: series, run, standard, sequential.

    Each run has a seed of its own. With sample_len a task holds the events that one run proposes, however long the
    series is (`_proposed_runs`). Without it a sample is as long as the series, and a run takes all of it.
    """
    return (_whole_runs if sample_len is None else _proposed_runs)(bars, events, sample_len, iterations, seed, key, ts)


def _places(bars: DataFrame, events: DataFrame, key: str, ts: str) -> DataFrame:
    """For each event _first and _past, the first and one past the last of its bars, and _rank: its place in the series, events that hold a bar first.

    Bars are counted by ranges of time (functions/ranks.py), not in one window for a series.
    """
    own = events.select(key, micros(F.col("t0"), OPEN).alias("_t0"), micros(F.col("t1"), OPEN).alias("_t1"))
    own = written(own.withColumn("_id", F.monotonically_increasing_id()), "events")
    at = bars.where(F.col(ts).isNotNull()).select(key, micros(F.col(ts)).alias("_at")).distinct()
    end = lambda kind, c: F.struct(F.lit(kind).alias("_kind"), F.col(c).alias("_at"))
    # at equal times starts come before bars and ends after them
    ends = own.select(key, "_id", F.explode(F.array(end(0, "_t0"), end(2, "_t1"))).alias("_end")).select(key, "_end._at", "_end._kind", "_id")
    line = ends.unionByName(at.select(key, "_at", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_id"))).withColumn("_bar", F.col("_kind") == 1)
    counted = ranked(line, key, ["_at", "_kind"], "_before", of="_bar").where(~F.col("_bar"))
    both = counted.groupBy(key, "_id").agg(*(F.max(F.when(F.col("_kind") == kind, F.col("_before"))).alias(n) for kind, n in ((0, "_first"), (2, "_past"))))
    return ranked(both.withColumn("_bare", F.col("_past") <= F.col("_first")), key, ["_bare", "_first", "_past"])


def share_alone(first: np.ndarray, past: np.ndarray, lo: int, hi: int, extra: int) -> float:
    """Mean of 1 / (alive + extra) over the bars from lo on before hi, alive being how many of the intervals hold a bar."""
    if hi <= lo:
        return 0.0
    at = np.concatenate([[lo, hi], np.clip(first, lo, hi), np.clip(past, lo, hi)])
    change = np.concatenate([[0, 0], np.ones(len(first), np.int64), np.full(len(past), -1)])
    order = np.argsort(at, kind="stable")
    alive = np.cumsum(change[order])[:-1]
    return float((np.diff(at[order]) / np.maximum(alive + extra, 1)).sum() / (hi - lo))


def accepted(first: np.ndarray, past: np.ndarray, chance: np.ndarray, size: int) -> list[int] | None:
    """Draws in proportion to the uniqueness given the draws so far, from events proposed with equal chances.

    A proposal is taken if its chance (uniform) is below its uniqueness, so that what is taken has the law of
    `lazy_draws`. None if the proposals do not suffice.
    """
    taken: list[int] = []
    for i in range(len(first)):
        if len(taken) == size:
            break
        if chance[i] < share_alone(first[taken], past[taken], first[i], past[i], 1):
            taken.append(i)
    return taken if len(taken) == size else None


def _sample_share(first: np.ndarray, past: np.ndarray) -> float:
    return float(np.mean([share_alone(first, past, a, b, 0) for a, b in zip(first, past, strict=True)])) if len(first) else float("nan")


def _proposed_runs(bars: DataFrame, events: DataFrame, sample_len: int, iterations: int, seed: int, key: str, ts: str) -> DataFrame:
    """Each run proposes places of events, which meet the events in one join; a run that takes too few proposes more in another round."""
    placed = _places(bars, events, key, ts)
    sizes = placed.groupBy(key).agg(F.count("*").alias("_n"), F.sum((~F.col("_bare")).cast("long")).alias("_holding")).withColumn("_h", F.xxhash64(key))
    open_runs = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("run"))
    kind = bars.schema[key].dataType.simpleString()
    numbers = lambda which, run, h: np.random.default_rng([seed, int(run), int(h) & (2**63 - 1), which])

    def round_of(runs: DataFrame, n_proposals: int) -> DataFrame:
        def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for name, n, holding, h, run in zip(*(pdf[c] for c in (key, "_n", "_holding", "_h", "run")), strict=True):
                    standard = np.floor(numbers(0, run, h).random(sample_len) * n)
                    proposed = np.floor(numbers(1, run, h).random(n_proposals) * (holding or n))
                    places = np.concatenate([standard, proposed]).astype(np.int64)
                    yield pd.DataFrame({key: name, "run": int(run), "_h": int(h), "_holding": int(holding), "_i": np.arange(len(places)), "_place": places})

        def draw(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_i")
            name, run, h, holding = (pdf[c].iloc[0] for c in (key, "run", "_h", "_holding"))
            first, past = pdf["_first"].to_numpy(), np.maximum(pdf["_first"], pdf["_past"]).to_numpy()
            standard = _sample_share(first[:sample_len], past[:sample_len])
            first, past = first[sample_len:], past[sample_len:]
            # where no event holds a bar all have equal chances
            taken = accepted(first, past, numbers(2, run, h).random(n_proposals), sample_len) if holding else list(range(sample_len))
            return pd.DataFrame({key: [name], "run": [int(run)], "standard": [standard], "sequential": [_sample_share(first[taken], past[taken]) if taken is not None else None], "_done": [taken is not None]})

        asked = runs.repartition(key, "run").mapInPandas(propose, f"{key} {kind}, run bigint, _h bigint, _holding bigint, _i bigint, _place bigint")
        met = asked.join(placed.select(F.col(key).alias("_key"), "_rank", "_first", "_past"), (F.col(key) == F.col("_key")) & (F.col("_place") == F.col("_rank")))
        return written(met.drop("_key", "_rank").groupBy(key, "run").applyInPandas(draw, f"{key} {kind}, run bigint, standard double, sequential double, _done boolean"), "runs")

    done, n_proposals = None, 4 * sample_len
    while True:
        found = round_of(open_runs, n_proposals)
        part = found.where("_done").drop("_done")
        done = part if done is None else done.unionAll(part)
        again = found.where("not _done").select(key, "run")
        if again.isEmpty():
            return done
        open_runs, n_proposals = open_runs.join(again, [key, "run"], "left_semi"), 4 * n_proposals


def _whole_runs(bars: DataFrame, events: DataFrame, sample_len: int | None, iterations: int, seed: int, key: str, ts: str) -> DataFrame:
    """A series goes out once for every RUNS_AT_ONCE runs, as numbers."""
    starts = F.explode(F.sequence(F.lit(0), F.lit(iterations - 1), F.lit(RUNS_AT_ONCE)))
    at = bars.select(key, F.col(ts).alias("_ts")).groupBy(key).agg(F.sort_array(F.collect_set("_ts")).alias("_bars"))
    spans_of = F.struct("t0", F.coalesce("t1", F.to_timestamp_ntz(F.lit("9999-01-01 00:00:00"))).alias("t1"))
    both = events.groupBy(key).agg(F.sort_array(F.collect_list(spans_of)).alias("_events")).join(at, key)
    # places of the events' ends among the bars: the series goes to its runs as numbers
    rows = both.select(
        key, F.xxhash64(key).alias("_h"), F.size("_bars").alias("_n"), F.transform("_bars", micros).alias("_at"),
        F.transform("_events", lambda e: micros(e["t0"])).alias("_t0"), F.transform("_events", lambda e: micros(e["t1"])).alias("_t1"),
    )
    parts = max(2 * bars.sparkSession.sparkContext.defaultParallelism, -(-iterations // RUNS_AT_ONCE))
    dealt = rows.withColumn("_run", starts).repartition(parts, key, "_run")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, h, bars_at, t0, t1, start in zip(pdf[key], pdf["_h"], pdf["_at"], pdf["_t0"], pdf["_t1"], pdf["_run"], strict=True):
                first, past = spans(np.asarray(bars_at), np.asarray(t0), np.asarray(t1))
                for i in range(int(start), min(int(start) + RUNS_AT_ONCE, iterations)):
                    out.append((name, i, *_compare(first, past, len(bars_at), sample_len or len(first), np.random.default_rng([seed, i, int(h) & (2**63 - 1)]))))
            yield pd.DataFrame(out, columns=[key, "run", "standard", "sequential"])

    return dealt.mapInPandas(run, f"{key} {bars.schema[key].dataType.simpleString()}, run bigint, standard double, sequential double")


def random_spans(n_events: int, n_bars: int, most: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Random intervals: start anywhere in the bars, length 1 to most - 1."""
    start = rng.integers(0, n_bars, n_events)
    return start, start + rng.integers(1, max(most, 2), n_events) + 1


def random_monte_carlo(spark: SparkSession, n_events: int = 10, n_bars: int = 100, most: int = 5, iterations: int = 1_000_000, seed: int = 0) -> DataFrame:
    """As monte_carlo, with random intervals in every run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i in pdf["id"]:
                rng = np.random.default_rng([seed, i])
                first, past = random_spans(n_events, n_bars, most, rng)
                rows.append((int(i), *_compare(first, past, int(past.max()), n_events, rng)))
            yield pd.DataFrame(rows, columns=["run", "standard", "sequential"])

    return spark.range(iterations).mapInPandas(run, "run bigint, standard double, sequential double")


def summary(runs: DataFrame) -> DataFrame:
    return runs.agg(*(f(c).alias(f"{n}_{c}") for c in ("standard", "sequential") for n, f in (("mean", F.avg), ("std", F.stddev_samp))))
