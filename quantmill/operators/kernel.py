"""A classifier with a Gaussian kernel, by random Fourier features and a linear machine.

cos(w.x + b) with w normal and b uniform averages to the kernel exp(-gamma |x - y|^2), so that a
linear support vector machine on such features stands for one with the kernel, at a cost that is
linear in the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .importance import assemble
from .reports import classification_report, weighted_f1


def split(data: DataFrame, test_share: float, seed: int = 0, id_: str = "id") -> tuple[DataFrame, DataFrame]:
    """Training and test rows; a hash of the id decides, so that both are the same in every run."""
    place = F.pmod(F.xxhash64(F.lit(seed), id_), F.lit(1 << 30)) / float(1 << 30)
    return data.where(place >= test_share), data.where(place < test_share)


def fourier(data: DataFrame, names: Sequence[str], gamma: float, n: int = 256, seed: int = 0) -> DataFrame:
    """The rows with n random Fourier features of the named columns as the vector column features."""
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, math.sqrt(2 * gamma), (n, len(names))), rng.uniform(0, 2 * math.pi, n)
    places = [data.columns.index(c) for c in names]

    def made(batches):
        for batch in batches:
            if any(batch.column(i).null_count for i in places):
                raise ValueError("a feature is null")
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in places])
            waves = np.cos(x @ w.T + b) * math.sqrt(2 / n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * n, pa.int32()), pa.array(waves.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "_waves"])

    out = data.mapInArrow(made, T.StructType([*data.schema.fields, T.StructField("_waves", T.ArrayType(T.DoubleType()))]))
    return out.withColumn("features", array_to_vector("_waves")).drop("_waves")


def kernel_machine(train: DataFrame, names: Sequence[str], cost: float = 1.0, gamma: float | None = None, label: str = "label", n: int = 256, seed: int = 0, max_iter: int = 50):
    """The fitted machine as a function that adds prediction to rows. gamma None: a linear machine on the columns."""
    from pyspark.ml.classification import LinearSVC

    made = (lambda rows: assemble(rows, names)) if gamma is None else (lambda rows: fourier(rows, names, gamma, n, seed))
    rows = made(train).persist()
    model = LinearSVC(labelCol=label, featuresCol="features", regParam=1 / (cost * max(1, rows.count())), maxIter=max_iter).fit(rows)
    rows.unpersist()
    return lambda data: model.transform(made(data)).drop("features", "rawPrediction")


def svm_report(data: DataFrame, names: Sequence[str], *, costs: Sequence[float] = (0.1, 1.0, 10.0), gammas: Sequence[float | None] = (None, 0.01, 0.1), test_share: float = 0.2, id_: str = "id", label: str = "label", seed: int = 0, n: int = 256, max_iter: int = 50) -> DataFrame:
    """For each cost and gamma (null: linear) the report of the test rows by label: precision, recall, f1, support, accuracy, weighted_f1."""
    train, test = split(data, test_share, seed, id_)
    out = None
    for gamma in gammas:
        for cost in costs:
            scored = kernel_machine(train, names, cost, gamma, label, n, seed, max_iter)(test)
            rows = scored.select(F.col(label).alias("actual"), F.col("prediction").alias("predicted"))
            part = classification_report(rows).crossJoin(weighted_f1(rows))  # one row for each label, and one row
            part = part.select(F.lit(float(cost)).alias("cost"), F.lit(gamma).cast("double").alias("gamma"), "*")
            out = part if out is None else out.unionAll(part)
    return out
