"""Order-dependent folds over long series with bounded memory.

Rows are dealt by key, sorted inside the partitions and streamed through Arrow batches:
a task holds one batch and one state, however long a series is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Step = Callable[[Any, dict], "dict | Sequence[dict] | None"]


def ordered_fold(df: DataFrame, key: str, order: Sequence[str], start: Callable[[], Any], step: Step, schema: str | T.StructType, finish: Callable[[Any, Any], "dict | None"] | None = None) -> DataFrame:
    """Fold the rows of each key in order.

    start() makes the state of a key; step(state, row) changes it in place and may return
    rows; finish(key, state) may return a last one. Result columns are those of schema.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)
    names = [f.name for f in schema.fields]

    def run(batches):
        state, current, began = None, None, False
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if not began or row[key] != current:
                    if began and finish and (last := finish(current, state)) is not None:
                        out.append(last)
                    state, current, began = start(), row[key], True
                got = step(state, row)
                if got is not None:
                    out.extend([got] if isinstance(got, dict) else got)
            if out:
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in out], schema=arrow)
        if began and finish and (last := finish(current, state)) is not None:
            yield pa.RecordBatch.from_pylist([{n: last.get(n) for n in names}], schema=arrow)

    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def ordered_scan(df: DataFrame, key: str, order: Sequence[str], start: Callable[[], Any], step: Callable[..., Any], reads: Sequence[str], adds: Sequence[str] = ()) -> DataFrame:
    """The rows of each key in order: those that step picks or, with adds, all of them with more columns.

    start() makes the state of a key; step(state, *values of reads) changes it in place and
    returns a boolean, or the numbers of adds. Only the key and the columns of reads become
    Python values; the rows themselves pass through in Arrow.
    """
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in adds)])

    def run(batches):
        state, current, began = None, None, False
        for batch in batches:
            got = []
            for k, *values in zip(*(batch.column(c).to_pylist() for c in (key, *reads)), strict=True):
                if not began or k != current:
                    state, current, began = start(), k, True
                got.append(step(state, *values))
            if not adds:
                yield batch.filter(pa.array(got, pa.bool_()))
                continue
            more = [pa.array([g[i] for g in got], pa.float64()) for i in range(len(adds))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *adds])

    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(run, schema)


class Ewm:
    """Exponentially weighted mean and deviation, adjusted and debiased; weights decay over nulls too."""

    __slots__ = ("alpha", "w", "w2", "mean", "s")

    def __init__(self, span: float):
        if span <= 0:
            raise ValueError("span must be positive")
        self.alpha, self.w, self.w2, self.mean, self.s = 2 / (span + 1), 0.0, 0.0, 0.0, 0.0

    def add(self, x: float | None) -> None:
        keep = 1 - self.alpha
        self.w, self.w2, self.s = self.w * keep, self.w2 * keep * keep, self.s * keep
        if x is None:
            return
        self.w, self.w2 = self.w + 1, self.w2 + 1
        before = self.mean
        self.mean += (x - before) / self.w
        self.s += (x - before) * (x - self.mean)

    @property
    def std(self) -> float | None:
        rest = self.w * self.w - self.w2
        return (self.s / self.w * self.w * self.w / rest) ** 0.5 if rest > 1e-12 else None
