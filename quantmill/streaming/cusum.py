"""The CUSUM filter, sampled bars and weighted deviations over streams.

State is kept by series; rows of one trigger are put in order of time and of a whole-number
column that tells rows of one time apart (``tie``; by default seq, where the stream has it). A
row that does not come after the last one seen is ignored; without a tie column rows of the
last time still count. So results equal those of a batch whose files arrive in order. A query
needs the RocksDB state store provider.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.folds import Ewm
from ..operators.filters import cusum_step

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Fold(StatefulProcessor):
    """One state row for each series: the last time and some numbers."""

    numbers: int = 0

    def __init__(self, ts: str, tie: str | None, value: str):
        self.ts, self.tie, self.value = ts, tie, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", T.StructType([T.StructField("last", T.StringType()), T.StructField("tie", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))]))

    def begin(self) -> list[float | None]:
        raise NotImplementedError

    def step(self, x: list, row) -> dict | None:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = self.state.get()
        last, x = ((kept[0], kept[1]), list(kept[2])) if kept is not None else (None, self.begin())
        out = []
        pdf = pd.concat(list(rows)).sort_values([self.ts, self.tie] if self.tie else [self.ts], kind="stable")
        for row in pdf.to_dict("records"):
            at = (pd.Timestamp(row[self.ts]).isoformat(timespec="microseconds"), int(row[self.tie]) if self.tie else 0)
            if last is not None and (at <= last if self.tie else at < last):
                continue
            last = at
            got = self.step(x, row)
            if got is not None:
                out.append(got)
        self.state.update((*last, x))
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


class _Cusum(_Fold):
    def __init__(self, ts: str, tie: str | None, value: str, limit: float):
        super().__init__(ts, tie, value)
        self.limit = limit

    def begin(self):
        return [None, 0.0, 0.0]

    def step(self, x: list, row):
        return row if cusum_step(x, row[self.value], self.limit) else None


class _Bars(_Cusum):
    def begin(self):
        return [0.0]

    def step(self, x: list, row):
        x[0] += row[self.value] or 0.0
        if x[0] >= self.limit:
            x[0] = 0.0
            return row
        return None


class _Deviation(_Cusum):
    def begin(self):
        return [0.0, 0.0, 0.0, 0.0]

    def step(self, x: list, row):
        e = Ewm(self.limit)
        e.w, e.w2, e.mean, e.s = x
        e.add(row[self.value])
        x[:] = [e.w, e.w2, e.mean, e.s]
        return row | {"ewm_mean": e.mean, "ewm_std": e.std}


def _run(stream: DataFrame, processor: StatefulProcessor, key: str, schema: T.StructType) -> DataFrame:
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, outputMode="append", timeMode="none")


def _tie(stream: DataFrame, tie: str | None) -> str | None:
    return tie or ("seq" if "seq" in stream.columns else None)


def stream_cusum(stream: DataFrame, limit: float, close: str = "close", *, key: str = "series_id", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """The rows at which the filter fires."""
    return _run(stream, _Cusum(ts, _tie(stream, tie), close, limit), key, stream.schema)


def stream_bars(stream: DataFrame, threshold: float, column: str, *, key: str = "series_id", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """The rows at which a running sum reaches the threshold and restarts."""
    return _run(stream, _Bars(ts, _tie(stream, tie), column, threshold), key, stream.schema)


def stream_ewm(stream: DataFrame, column: str, span: float, *, key: str = "series_id", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """Adds ewm_mean and ewm_std to every row."""
    more = [T.StructField("ewm_mean", T.DoubleType()), T.StructField("ewm_std", T.DoubleType())]
    return _run(stream, _Deviation(ts, _tie(stream, tie), column, span), key, T.StructType([*stream.schema.fields, *more]))


def run_to_table(stream: DataFrame) -> DataFrame:
    """Run a stream over what is there into files of the shared folder, and read them.

    The folder is spark.checkpoint.dir, which all executors share; a temporary one is used
    only where that is unset and all runs on this machine. The files go when the application ends.
    """
    import re
    import tempfile
    import uuid

    spark = stream.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = root or tempfile.mkdtemp(prefix="quantmill-")
    path = f"{root.rstrip('/')}/quantmill/stream-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
