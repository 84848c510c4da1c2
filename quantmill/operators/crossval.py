"""Purged cross-validation.

Observations are intervals: t0, t1 and their own id. Folds are rows, not splits of the
driver; fitting is left to pyspark.ml.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import ranked
from ..functions.scans import Running, scan
from ..functions.tables import written


def overlaps(t0: Column, t1: Column, start: Column, end: Column) -> Column:
    """Whether an observation begins or ends in [start, end], or spans it."""
    return t0.between(start, end) | t1.between(start, end) | ((t0 <= start) & (end <= t1))


#: Rows of time that a task sweeps where there is no key.
SWEEP_ROWS = 1 << 20


def train_times(events: DataFrame, tests: DataFrame, *, key: str | None = None) -> DataFrame:
    """Events that overlap no test interval (start, end). Nulls overlap nothing.

    With a key it is an anti join on it. Without one, time is swept: a time lies in a test if the greatest
    end of the tests that begin up to it reaches it, and an event spans a test if the least end of the tests
    that begin from its start on is not after its end. Both sweeps run over ranges of time side by side,
    each with what the ranges before it leave open (functions/scans.py). Tests that end before they begin
    are none without a key.
    """
    if key:
        on = overlaps(F.col("e.t0"), F.col("e.t1"), F.col("x.start"), F.col("x.end"))
        return events.alias("e").join(tests.alias("x"), (F.col(f"e.{key}") == F.col(f"x.{key}")) & on, "left_anti")
    rows = written(events.withColumn("_id", F.monotonically_increasing_id()), "events")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    proper = tests.where("start <= end").select(micros("start").alias("_at"), micros("end").alias("_end"))
    none = F.lit(None).cast("long")
    points = rows.select("_id", micros("t0").alias("_t0"), micros("t1").alias("_t1"))

    def swept(ends: Column, at: DataFrame, sign: int) -> DataFrame:
        line = proper.select((sign * F.col("_at")).alias("_at"), F.lit(0).alias("_kind"), ends.cast("double").alias("_end"), none.alias("_id"), none.alias("_to"))
        asked = at.select((sign * F.col("_at")).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_end"), "_id", "_to")
        both = line.unionAll(asked).withColumn("_all", F.lit(0))
        return scan(both, "_all", ["_at", "_kind"], Running("_end", "_open"), SWEEP_ROWS).where("_kind = 1")

    # micros of times between the years 1684 and 2255 are exact as doubles
    each = points.select("_id", F.explode(F.array("_t0", "_t1")).alias("_at")).where("_at is not null").select("_id", "_at", F.col("_at").alias("_to"))
    inside = swept(F.col("_end"), each, 1).where("_open >= _to").select("_id")
    from_start = points.where("_t0 is not null and _t1 is not null").select("_id", F.col("_t0").alias("_at"), F.col("_t1").alias("_to"))
    spans = swept(-F.col("_end"), from_start, -1).where("-_open <= _to").select("_id")
    return rows.join(inside.unionAll(spans), "_id", "left_anti").drop("_id")


def embargo(times: DataFrame, share: float, *, key: str | None = None, order: str = "t0") -> DataFrame:
    """All but the last k = int(n * share) rows of each key, or of all; places come from ranges of time (functions/ranks.py)."""
    own = times if key else times.withColumn("_all", F.lit(0))
    name = key or "_all"
    placed = ranked(own, name, [order], "_i")
    sizes = placed.groupBy(F.col(name).alias("_key")).agg(F.count("*").alias("_n"))
    kept = placed.join(sizes, F.col(name).eqNullSafe(F.col("_key"))).where(F.col("_i") < F.col("_n") - F.floor(F.col("_n") * share))
    return kept.select(times.columns)


def _fold_of(place: Column, n: Column, splits: int) -> Column:
    """The number of the contiguous fold of a place (from 0) among n, larger folds first."""
    size, larger = F.floor(n / splits), n % splits
    head = larger * (size + 1)
    return F.when(place < head, F.floor(place / (size + 1))).otherwise(larger + F.floor((place - head) / F.greatest(size, F.lit(1)))).cast("int")


def purged_folds(events: DataFrame, n_splits: int = 5, embargo_share: float = 0.01, *, key: str = "series_id", id_: str = "id", textbook: bool = False, ranges: bool = False) -> DataFrame:
    """Rows (series, fold, id, role) with role train or test; purged and embargoed rows are in neither.

    Folds are contiguous in t0, larger ones first. The test interval runs from t1 of its first
    row (textbook: from t0) to t1 of its last. The embargo takes the last k training rows,
    k = max(1, int(n * share)), or none for share 0 (textbook: the k rows after the test fold).
    ranges: places come from ranges of time instead of a window over each series, for series that are
    too long for a task; the rows are then written to the shared folder.
    """
    if n_splits < 2:
        raise ValueError("at least two folds")
    base = events.select(key, id_, "t0", "t1")
    if ranges:
        placed = ranked(base, key, ["t0", id_], "_i")
        sizes = placed.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
        rows = placed.join(sizes, F.col(key) == F.col("_key")).drop("_key").withColumn("_fold", _fold_of(F.col("_i"), F.col("_n"), n_splits)).withColumn("_i", F.col("_i") + 1)
    else:
        w = Window.partitionBy(key).orderBy("t0", id_)
        rows = base.withColumns({"_fold": F.ntile(n_splits).over(w) - 1, "_i": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(key))})
    ordered = F.struct("t0", id_)
    windows = rows.groupBy(key, F.col("_fold").alias("fold")).agg(F.min_by("t0" if textbook else "t1", ordered).alias("start"), F.max_by("t1", ordered).alias("end"), F.max("_i").alias("_last"))
    both = rows.join(windows, key)  # n_splits rows for each row of the series
    is_test = F.col("_fold") == F.col("fold")
    clash = overlaps(F.col("t0"), F.col("t1"), F.col("start"), F.col("end"))
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * embargo_share)) if embargo_share > 0 else F.lit(0)
    train = both.where(~is_test & ~clash)
    if textbook:
        train = train.where(~((F.col("_i") > F.col("_last")) & (F.col("_i") <= F.col("_last") + k)))
    elif ranges and embargo_share > 0:
        lasts = ranked(train.withColumn("_of", F.struct(key, "fold")), "_of", ["t0", id_], "_place")
        counts = lasts.groupBy(F.col("_of").alias("_o")).agg(F.count("*").alias("_size"))
        train = lasts.join(counts, F.col("_of") == F.col("_o")).where(F.col("_size") - F.col("_place") > k)
    elif embargo_share > 0:
        back = F.row_number().over(Window.partitionBy(key, "fold").orderBy(F.desc("t0"), F.desc(id_)))
        train = train.withColumn("_b", back).where(F.col("_b") > k)
    role = lambda df, name: df.select(key, "fold", id_, F.lit(name).alias("role"))
    return role(train, "train").unionAll(role(both.where(is_test), "test"))


def _log_loss(label: str, weight: str | None, proba: str = "proba") -> Column:
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.when(F.col(label) == 1, F.col(proba)).otherwise(1 - F.col(proba))))
    w = F.col(weight) if weight else F.lit(1.0)
    return F.sum(F.log(p) * w) / F.sum(w)


def _share_right(label: str, weight: str | None, prediction: str = "prediction") -> Column:
    w = F.col(weight) if weight else F.lit(1.0)
    return F.sum(F.when(F.col(label) == F.col(prediction), w).otherwise(0.0)) / F.sum(w)


def neg_log_loss(scored: DataFrame, label: str = "label", proba: str = "proba", weight: str | None = None) -> float:
    """Weighted mean log of the probability given to the true class (label 0 or 1)."""
    return scored.agg(_log_loss(label, weight, proba)).first()[0]


def accuracy(scored: DataFrame, label: str = "label", prediction: str = "prediction", weight: str | None = None) -> float:
    return scored.agg(_share_right(label, weight, prediction)).first()[0]


def f1(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> float:
    hit, all_ = F.sum(((F.col(label) == 1) & (F.col(prediction) == 1)).cast("double")), F.sum((F.col(label) == 1).cast("double") + (F.col(prediction) == 1).cast("double"))
    return scored.agg(F.when(all_ > 0, 2 * hit / all_).otherwise(0.0)).first()[0]


SCORERS: dict[str, Callable[..., float]] = {"neg_log_loss": neg_log_loss, "accuracy": accuracy}
#: The same as aggregates of scored rows, from the names of label and weight.
SCORES: dict[str, Callable[..., Column]] = {"neg_log_loss": _log_loss, "accuracy": _share_right}


def _scored(model, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(rows)
    if "probability" not in out.columns:
        return out
    made = F.col("probability") if out.schema["probability"].dataType.typeName() == "array" else vector_to_array("probability")
    return out.withColumn("proba", made[1])


def weighted(estimator, weight: str | None):
    """The estimator with its weights from a column; of a Pipeline its last stage takes them."""
    from pyspark.ml import Pipeline

    if weight is None:
        return estimator
    if isinstance(estimator, Pipeline):
        *head, last = estimator.getStages()
        return Pipeline(stages=[*head, weighted(last, weight)])
    if not estimator.hasParam("weightCol"):
        raise ValueError(f"{type(estimator).__name__} takes no weights")
    return estimator.copy({estimator.getParam("weightCol"): weight})


def shuffled(rows: DataFrame, id_: str, seed: int) -> DataFrame:
    """The rows in an order that a hash of their id gives: dealt out by it, sorted inside partitions."""
    place = F.xxhash64(F.lit(seed), id_)
    return rows.repartition(place).sortWithinPartitions(place)


def cv_score(estimator, data: DataFrame, folds: DataFrame, *, id_: str = "id", label: str = "label", weight: str | None = None, scoring: str = "neg_log_loss", shuffle: int | None = None) -> list[float]:
    """Score of each fold; data has the features and labels of each id, folds comes from purged_folds.

    The estimator (of a Pipeline the last stage) fits with the weights that the scores are
    weighted by. shuffle: a seed to put the training rows of a fold in another order.
    """
    if scoring not in SCORERS:
        raise ValueError(f"scoring must be one of {sorted(SCORERS)}")
    kept = folds.select("fold", id_, "role").persist()
    scores = _fold_scores(estimator, with_roles(data, kept, id_), fold_numbers(kept), id_=id_, label=label, weight=weight, scoring=scoring, shuffle=shuffle)
    kept.unpersist()
    return scores


def with_roles(data: DataFrame, folds: DataFrame, id_: str = "id") -> DataFrame:
    """The rows that are in some fold, with _train and _test: the numbers of the folds in which they have that role.

    One join for all folds, without a broadcast, written to the shared folder: a fold is then a filter, however
    many models are fitted, and a model of few features reads their columns only.
    """
    of = lambda name: F.collect_set(F.when(F.col("role") == name, F.col("fold")))
    roles = folds.groupBy(id_).agg(of("train").alias("_train"), of("test").alias("_test"))
    return written(data.join(roles.hint("merge"), id_), "folds")


def in_fold(rows: DataFrame, k: int, role: str) -> DataFrame:
    """The rows of with_roles that have the role (train, test) in fold k."""
    return rows.where(F.array_contains(f"_{role}", k)).drop("_train", "_test")


def fold_numbers(folds: DataFrame) -> list[int]:
    return sorted(r[0] for r in folds.select("fold").distinct().collect())


def _fold_scores(estimator, rows: DataFrame, numbers: Sequence[int], *, id_: str, label: str, weight: str | None, scoring: str, shuffle: int | None = None) -> list[float]:
    """Score of each of the folds of rows with their roles; caches nothing, so that threads can share the rows."""
    scores = []
    for k in numbers:
        train = in_fold(rows, k, "train")
        model = weighted(estimator, weight).fit(train if shuffle is None else shuffled(train, id_, shuffle))
        scores.append(SCORERS[scoring](_scored(model, in_fold(rows, k, "test")), label=label, weight=weight))
    return scores


def hyper_fit(estimator, grid: Sequence[dict], data: DataFrame, folds: DataFrame, *, id_: str = "id", label: str = "label", weight: str | None = None, random_search: int = 0, seed: int = 0, bagging: tuple[int, float] | None = None):
    """The model refitted on all data with the parameters of the best mean score, and all scores.

    grid: parameter maps as ParamGridBuilder makes them. Labels 0 and 1 score by F1, others by
    log loss; random_search tries so many of the maps. bagging: members and the share of rows that
    each draws with replacement; the best parameters are then fitted as a bag.
    """
    import random

    maps = list(grid)
    if random_search:
        maps = random.Random(seed).sample(maps, min(random_search, len(maps)))
    two = {r[0] for r in data.select(label).distinct().limit(3).collect()} <= {0, 1, 0.0, 1.0}
    estimator = weighted(estimator, weight)
    kept = folds.select("fold", id_, "role").persist()
    numbers, rows = fold_numbers(kept), with_roles(data, kept, id_)
    results = []
    for params in maps:
        tuned, scores = estimator.copy(params), []
        for k in numbers:
            out = _scored(tuned.fit(in_fold(rows, k, "train")), in_fold(rows, k, "test"))
            scores.append(f1(out, label) if two else neg_log_loss(out, label, weight=weight))
        results.append((sum(scores) / len(scores), params))
    kept.unpersist()
    best = max(results, key=lambda r: r[0])[1]
    tuned = estimator.copy(best)
    return (Bag(tuned, *bagging, seed=seed, id_=id_).fit(data) if bagging else tuned.fit(data)), results


class Bag:
    """Copies of a classifier, each fitted on rows drawn with replacement; probabilities are averaged.

    How often a member draws a row is a Poisson number from a hash of seed, member and id, so that it
    does not depend on how the rows are dealt out, and a lost partition comes back the same.
    """

    def __init__(self, estimator, members: int = 10, share: float = 1.0, seed: int = 0, id_: str = "id"):
        if members < 1 or share <= 0:
            raise ValueError("a bag needs members and rows")
        self.estimator, self.members, self.share, self.seed, self.id_, self.models = estimator, members, share, seed, id_, []

    def drawn(self, data: DataFrame, member: int) -> DataFrame:
        """The rows that a member draws, as often as it draws them."""
        u = F.pmod(F.xxhash64(F.lit(self.seed), F.lit(member), self.id_), F.lit(1 << 53)) / float(1 << 53)
        p = upto = math.exp(-self.share)
        times, k = F.lit(0), 0
        while 1 - upto > 1e-15 and k < 1000:
            times = times + (u >= upto).cast("int")
            k += 1
            p *= self.share / k
            upto += p
        return data.withColumn("_times", times).where("_times > 0").withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times", "_time")

    def fit(self, data: DataFrame) -> Bag:
        self.models = [self.estimator.fit(self.drawn(data, m)) for m in range(self.members)]
        return self

    def transform(self, data: DataFrame) -> DataFrame:
        """The columns of data, probability (an array over classes) and prediction (the first of the likeliest)."""
        from pyspark.ml.functions import vector_to_array

        names, out = list(data.columns), data
        for m, model in enumerate(self.models):
            scored = model.transform(out.select(*names, *(f"_m{i}" for i in range(m))))
            out = scored.withColumn(f"_m{m}", vector_to_array("probability"))
        each = [F.col(f"_m{m}") for m in range(self.members)]
        mean = F.transform(each[0], lambda _, i: sum((F.get(p, i) for p in each[1:]), F.get(each[0], i)) / self.members)
        out = out.select(*names, mean.alias("probability"))
        return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))
