"""The shared folder, lineage cuts and small column helpers."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Only where the setting is absent and all runs on this machine (a local master, as in
    tests) a temporary folder is made and set as the checkpoint folder.
    """
    known = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if known:
        return known.rstrip("/")
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get().rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quantmill-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df under the shared folder as Parquet and read it back.

    Cuts the lineage so that neither a retry nor a second use recomputes it; the
    files outlive any executor, and go when the application ends (or by ``removed``).
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/quantmill/{spark.sparkContext.applicationId}"
    path, files = _path(spark, folder)
    files.mkdirs(path)
    files.deleteOnExit(path)
    place = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def removed(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for table in tables:
        for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path, files = _path(table.sparkSession, name)
            files.delete(path, True)


def in_arrow(rows: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """mapInArrow in batches of at most ``BATCH_BYTES`` (a longer row alone), whatever the rows' lengths.

    The session's limit of bytes a batch is lowered to that where it is higher. A task gives
    back the memory of its kernels at its end, for Python workers live on.
    """
    conf = rows.sparkSession.conf
    if rows.sparkSession._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        conf.set(BATCH_KEY, str(BATCH_BYTES))

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only where the C library can
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return rows.mapInArrow(task, schema)


def text_bytes(column: str = "text") -> Column:
    """Text as UTF-8 bytes, null as empty: what the Arrow kernels read."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def let(value: Column, body) -> Column:
    """Evaluate value once and use it many times inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)
