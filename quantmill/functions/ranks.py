"""Places of rows in an order, without a window over a whole series or table.

Rows are dealt out by ranges of key and order, so that a task holds consecutive rows however
they spread over the series; each counts its own rows, and the counts of the partitions before it
are added. Only a series that goes on from one partition to the next needs that, so there is at
most one such number for each partition, and it is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import written


def runs(column: pa.Array) -> tuple[np.ndarray, list]:
    """Where runs of equal values (nulls are equal) begin, with the end last; and their values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(1, np.int64), []
    if pa.types.is_struct(column.type):
        inner = column.flatten()
        bounds = np.unique(np.concatenate([runs(c)[0] for c in [*inner, column.is_null()]]))
        return bounds, [column[int(i)].as_py() for i in bounds[:-1]]
    encoded = pc.run_end_encode(column)
    return np.concatenate([[0], encoded.run_ends.to_numpy(zero_copy_only=False).astype(np.int64)]), encoded.values.to_pylist()


def ranked(df: DataFrame, key: str, order: Sequence[str], name: str = "_rank", of: str | None = None) -> DataFrame:
    """The rows with their place (from 0) among those of their key, in order.

    The rows are written to the shared folder, so that the places stay what they are; rows that
    agree in key and order are placed as they come. of: a boolean column; a place is then the number
    of rows before for which it holds.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_rank_part", T.IntegerType()), T.StructField("_rank_at", T.LongType())])

    def count(batches):
        part, last, n = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            bounds, values = runs(batch.column(key))
            counts = np.ones(batch.num_rows, np.int64) if of is None else batch.column(of).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(counts)
            at = upto - counts
            for i, value in enumerate(values):
                lo, hi = bounds[i], bounds[i + 1]
                n = n if i == 0 and value == last else 0
                first = int(at[lo])
                at[lo:hi] += n - first
                n, last = n + int(upto[hi - 1]) - first, value
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(at)], [*batch.schema.names, "_rank_part", "_rank_at"])

    dealt = df.repartitionByRange(F.col(key), *map(F.col, order)).sortWithinPartitions(key, *order)
    table = written(dealt.mapInArrow(count, schema), "ranked")
    sizes = table.groupBy(F.col(key).alias("_rank_key"), F.col("_rank_part").alias("_rank_of")).agg((F.max("_rank_at") + 1 if of is None else F.sum(F.col(of).cast("long"))).alias("_rank_size"))
    earlier = Window.partitionBy("_rank_key").orderBy("_rank_of").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_rank_before", F.sum("_rank_size").over(earlier)).where("_rank_before is not null").drop("_rank_size")
    both = table.join(F.broadcast(before), F.col(key).eqNullSafe(F.col("_rank_key")) & (F.col("_rank_part") == F.col("_rank_of")), "left")
    return both.select(*df.columns, (F.col("_rank_at") + F.coalesce("_rank_before", F.lit(0))).alias(name))


def numbered(df: DataFrame, order: Sequence[str], name: str = "_rank") -> DataFrame:
    """The rows with their place (from 0) in the whole table, in order."""
    return ranked(df.withColumn("_all", F.lit(0)), "_all", order, name).drop("_all")


def permuted(df: DataFrame, columns: Sequence[str], seed: int, id_: str = "id") -> DataFrame:
    """The frame with columns shuffled together over all its rows, each permutation being as likely as any other.

    The values at each place in the order of a hash of id_ go to the row at that place in the
    order of id_. Where id_ is unique, seed and rows alone decide, however the rows are dealt out.
    """
    values = df.select(F.col(id_).alias("_id"), F.xxhash64(F.lit(seed), id_).alias("_hash"), *(F.col(c).alias(f"_v_{c}") for c in columns))
    shuffled = numbered(values, ["_hash", "_id"]).drop("_hash", "_id")
    rows = numbered(df.drop(*columns), [id_])
    return rows.join(shuffled, "_rank").select(*(F.col(f"_v_{c}").alias(c) if c in columns else F.col(c) for c in df.columns))
