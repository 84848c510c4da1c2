"""Feature importance with pyspark.ml trees, and orthogonal features."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ranks
from .crossval import SCORERS, SCORES, _fold_scores, _scored, fold_numbers, in_fold, with_roles


#: Features whose jobs run side by side.
AT_ONCE = 8


def _each(spark: SparkSession, f: Callable, names: Sequence[str]) -> list:
    """f(place, name) for each name in order, by threads of the driver: small jobs share the executors."""
    from pyspark import inheritable_thread_target

    with ThreadPool(min(AT_ONCE, max(1, len(names)))) as pool:
        return pool.starmap(inheritable_thread_target(spark)(f), list(enumerate(names)), chunksize=1)


def assemble(df: DataFrame, names: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(names), outputCol=out).transform(df)


def tree_importances(spark: SparkSession, model, names: Sequence[str]) -> DataFrame:
    """tree, feature, importance of a fitted forest (0 counts as missing)."""
    rows = [(k, n, float(v) if v > 0 else None) for k, t in enumerate(model.trees) for n, v in zip(names, t.featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "tree int, feature string, importance double")


def mdi(importances: DataFrame, clusters: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Mean decrease of impurity: mean and standard error over trees by feature (or cluster), scaled to sum 1."""
    rows = importances
    if clusters:
        of = F.create_map(*(F.lit(x) for c, fs in clusters.items() for f in fs for x in (f, c)))
        rows = rows.withColumn("feature", of[F.col("feature")]).groupBy("tree", "feature").agg(F.sum("importance").alias("importance"))
    n = F.count("*")
    s = rows.groupBy("feature").agg(F.avg("importance").alias("m"), (F.stddev_samp("importance") / F.sqrt(n)).alias("s"))
    total = F.sum("m").over(Window.partitionBy(F.lit(1)))
    return s.select("feature", F.coalesce(F.col("m") / total, F.lit(0.0)).alias("mean"), F.coalesce(F.col("s") / total, F.lit(0.0)).alias("std"))


def permuted(df: DataFrame, column: str, seed: int, id_: str = "id") -> DataFrame:
    """The frame with one column shuffled over all its rows (functions/ranks.py)."""
    return ranks.permuted(df, [column], seed, id_)


def each_permuted(df: DataFrame, names: Sequence[str], seed: int, id_: str = "id") -> DataFrame:
    """For each name the whole frame with that column shuffled, and _feature: the place of the name.

    One job for all of them: the values of all columns are ranked by column and hash at once,
    brought together by place, joined to the rows once, and only then are the rows multiplied.
    """
    rows = ranks.numbered(df, [id_])
    one = lambda j, n: F.struct(F.lit(j).alias("j"), F.xxhash64(F.lit(seed + 2 * j), id_).alias("hash"), F.col(n).cast("double").alias("value"))
    long = df.select(F.col(id_).alias("_id"), F.explode(F.array(*(one(j, n) for j, n in enumerate(names)))).alias("_one")).select("_id", "_one.*")
    placed = ranks.ranked(long, "j", ["hash", "_id"]).groupBy("_rank").agg(F.sort_array(F.collect_list(F.struct("j", "value"))).alias("_values"))
    each = rows.join(placed, "_rank").withColumn("_one", F.explode("_values"))
    columns = [F.when(F.col("_one.j") == names.index(c), F.col("_one.value")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns]
    return each.select(*columns, F.col("_one.j").alias("_feature"))


def _summary(spark: SparkSession, rows: list[tuple], ddof: int) -> DataFrame:
    out = []
    for name, values in rows:
        v = np.asarray(values, float)
        v = np.where(np.isnan(v) | (v == -math.inf), 0.0, v)
        out.append((name, float(v.mean()), float(v.std(ddof=ddof) / math.sqrt(len(v))) if len(v) > ddof else 0.0))
    return spark.createDataFrame(out, "feature string, mean double, std double")


def mda(estimator, data: DataFrame, names: Sequence[str], folds: DataFrame, *, id_: str = "id", label: str = "label", weight: str | None = None, scoring: str = "neg_log_loss", seed: int = 0) -> tuple[DataFrame, float]:
    """Loss of score when a column is shuffled, relative to -score (log loss) or 1 - score; and the mean fold score."""
    score = SCORERS[scoring]
    names = list(names)
    kept = folds.select("fold", id_, "role").persist()
    base, lost = [], {n: [] for n in names}
    whole_table = with_roles(data, kept, id_)
    for k in fold_numbers(kept):
        model = estimator.fit(assemble(in_fold(whole_table, k, "train"), names))
        test = in_fold(whole_table, k, "test").persist()
        base.append(score(_scored(model, assemble(test, names)), label=label, weight=weight))
        scored = _scored(model, assemble(each_permuted(test, names, seed, id_), names))
        found = {r["_feature"]: r["score"] for r in scored.groupBy("_feature").agg(SCORES[scoring](label, weight).alias("score")).collect()}
        for j, n in enumerate(names):
            lost[n].append(found[j])
        test.unpersist()
    kept.unpersist()
    whole = lambda s: -s if scoring == "neg_log_loss" else 1 - s
    rows = []
    for n in names:
        rows.append((n, [(b - s) / whole(s) if whole(s) else math.nan for b, s in zip(base, lost[n], strict=True)]))
    return _summary(data.sparkSession, rows, 1), float(np.mean(base))


def sfi(estimator, data: DataFrame, names: Sequence[str], folds: DataFrame, *, id_: str = "id", label: str = "label", weight: str | None = None, scoring: str = "neg_log_loss") -> DataFrame:
    """Cross-validated score of each single feature: mean and (population) standard error."""
    if scoring not in SCORERS:
        raise ValueError(f"scoring must be one of {sorted(SCORERS)}")
    kept = folds.select("fold", id_, "role").persist()
    numbers, table = fold_numbers(kept), with_roles(data, kept, id_)
    kept.unpersist()
    scores = _each(data.sparkSession, lambda _, n: _fold_scores(estimator, assemble(table, [n]), numbers, id_=id_, label=label, weight=weight, scoring=scoring), names)
    rows = list(zip(names, scores, strict=True))
    return _summary(data.sparkSession, rows, 0)


def importance_analysis(data: DataFrame, names: Sequence[str], folds: DataFrame, *, methods: Sequence[str] = ("mdi", "mda", "sfi"), id_: str = "id", label: str = "label", trees: int = 1000, seed: int = 0, scoring: str = "accuracy") -> DataFrame:
    """method, feature, mean, std, and the cross-validated score, for a forest with one feature a split and entropy."""
    from pyspark.ml.classification import RandomForestClassifier

    from .crossval import cv_score

    forest = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, impurity="entropy", featureSubsetStrategy="1", seed=seed)
    spark = data.sparkSession
    cv = float(np.mean(cv_score(forest, assemble(data, names), folds, id_=id_, label=label, scoring=scoring)))
    made = {
        "mdi": lambda: mdi(tree_importances(spark, forest.fit(assemble(data, names)), names)), "mda": lambda: mda(forest, data, names, folds, id_=id_, label=label, scoring=scoring, seed=seed)[0],
        "sfi": lambda: sfi(forest, data, names, folds, id_=id_, label=label, scoring=scoring),
    }
    out = None
    for m in methods:
        part = made[m]().select(F.lit(m).alias("method"), "feature", "mean", "std", F.lit(cv).alias("cv_score"))
        out = part if out is None else out.unionAll(part)
    return out


def eigenvectors(dot: np.ndarray, threshold: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, descending, and vectors up to a share of the variance."""
    values, vectors = np.linalg.eigh(dot)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = min(int(np.searchsorted(np.cumsum(values) / values.sum(), threshold)) + 1, len(values))
    return values[:keep], vectors[:, :keep]


def _standard(df: DataFrame, names: Sequence[str]) -> tuple[dict[str, tuple[float, float]], np.ndarray]:
    """Mean and deviation of each column, and the correlation matrix over the rows that have both columns: sums of
    products of the centred columns, one matrix from each partition."""
    k = len(names)
    row = df.agg(*(f(n) for n in names for f in (F.avg, F.stddev_samp))).first()
    stats = {n: (row[2 * i], row[2 * i + 1]) for i, n in enumerate(names)}
    mean = np.array([stats[n][0] or 0.0 for n in names])

    def sums(batches):
        total = np.zeros((4, k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            there = ~np.column_stack([c.is_null().to_numpy(zero_copy_only=False) for c in batch.columns])
            x, m = np.where(there, x - mean, 0.0), there.astype(float)
            total += np.stack([x.T @ x, x.T @ m, (x * x).T @ m, m.T @ m])
        yield pa.RecordBatch.from_pydict({"s": [total.tobytes()]})

    parts = df.select(*(F.col(n).cast("double") for n in names)).mapInArrow(sums, "s binary").collect()
    xy, sx, xx, n = sum((np.frombuffer(r[0]).reshape(4, k, k) for r in parts), np.zeros((4, k, k)))
    n = np.maximum(n, 1)
    flat = np.array([not stats[c][1] for c in names])
    over = np.where(flat | flat[:, None], 0.0, np.maximum(xx - sx * sx / n, 0.0))
    over = np.sqrt(over * over.T)
    corr = np.where(over == 0, np.eye(k), (xy - sx * sx.T / n) / np.where(over == 0, 1.0, over))
    return stats, corr


def orthogonal(df: DataFrame, names: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """Adds PC_1 ...: standardised columns projected on the eigenvectors of their correlations, by a product with
    their matrix in each batch; null where a column is."""
    stats, corr = _standard(df, names)
    _, vectors = eigenvectors(corr, threshold)
    mean = np.array([math.nan if stats[n][0] is None else stats[n][0] for n in names])
    scale = np.array([stats[n][1] or 1.0 for n in names])
    added = [f"PC_{k + 1}" for k in range(vectors.shape[1])]
    places = [df.columns.index(n) for n in names]

    def project(batches):
        for batch in batches:
            columns = [batch.column(i) for i in places]
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns])
            missing = np.any([c.is_null().to_numpy(zero_copy_only=False) for c in columns], axis=0)
            z = (x - mean) / scale
            # sums over the columns in their order, whatever the batch
            out = np.zeros((len(z), len(added)))
            for j in range(z.shape[1]):
                out += z[:, j, None] * vectors[j]
            made = [pa.array(out[:, k], pa.float64(), mask=missing) for k in range(len(added))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *added])

    return df.mapInArrow(project, T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in added)]))


def _ranks(x: np.ndarray) -> np.ndarray:
    _, place, times = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(times)
    return (last - (times - 1) / 2)[place]


def kendall(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> float:
    """Kendall's tau-b, or with weights (added for each pair) its weighted form."""
    i, j = np.triu_indices(len(x), 1)
    a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
    w = np.ones(len(i)) if weights is None else weights[i] + weights[j]
    return float((w * a * b).sum() / math.sqrt((w * a * a).sum() * (w * b * b).sum()))


def weighted_kendall(importance: np.ndarray, rank: np.ndarray) -> float:
    """Weighted tau of importance against 1 / rank, with hyperbolic weights by descending importance, then by
    descending 1 / rank, averaged."""
    y = 1 / rank
    taus = []
    for by in (np.lexsort((y, importance)), np.lexsort((importance, y))):
        place = np.empty(len(by))
        place[by[::-1]] = np.arange(len(by))
        taus.append(kendall(importance, y, 1 / (place + 1)))
    return float(np.mean(taus))


def pca_agreement(df: DataFrame, importance: dict[str, float], threshold: float = 0.95) -> DataFrame:
    """pearson, spearman, kendall and weighted_kendall of importances with the loadings |vector * eigenvalue|."""
    names = list(importance)
    _, corr = _standard(df, names)
    values, vectors = eigenvectors(corr, threshold)
    x = np.array([importance[n] for n in names])
    load = np.abs(vectors * values)
    xs, ys = np.repeat(x[:, None], load.shape[1], axis=1).ravel(), load.ravel()
    rank = len(x) + 1 - _ranks(load.sum(axis=1))
    row = (float(np.corrcoef(xs, ys)[0, 1]), float(np.corrcoef(_ranks(xs), _ranks(ys))[0, 1]), kendall(xs, ys), weighted_kendall(x, rank))
    return df.sparkSession.createDataFrame([row], "pearson double, spearman double, kendall double, weighted_kendall double")


def sorted_importances(spark: SparkSession, model, names: Sequence[str]) -> DataFrame:
    """feature, importance of a fitted tree model, greatest first."""
    values = model.featureImportances.toArray()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values, strict=True)], "feature string, importance double").orderBy(F.desc("importance"), "feature")
