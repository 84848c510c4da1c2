"""Interval-valued rows: sweep lines and sums between two times.

Counts of intervals that cover a point come from a sweep line and a running sum, never from
a range join of points and intervals. With ``block_days`` running sums go by blocks of days:
sums within each block, and before it the totals of the earlier ones, so that a long series
is dealt out and only one row a block meets in a task; it reads its input twice and is meant
for series that are too long for one task. Where the pairs themselves are asked
for, the join is on the series and a bucket of days, so that a long series is dealt out and
an interval meets only the points of its own days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _block(ts: str, days: int) -> Column:
    return F.floor(F.datediff(F.col(ts), F.lit("1970-01-01").cast("date")) / days)


def running_sums(line: DataFrame, key: str, ts: str, sums: Sequence[str], block_days: int | None = None) -> DataFrame:
    """The rows of line with the columns of sums replaced by their running sums, by ts and _kind.

    Nulls add nothing; rows without a time come first. block_days: days of one series that a
    task sorts (None: the whole series).
    """
    own = [c for c in line.columns if c not in sums]
    if block_days is None:
        w = Window.partitionBy(key).orderBy(ts, "_kind").rowsBetween(Window.unboundedPreceding, 0)
        return line.select(*own, *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in sums))
    cut = line.withColumn("_block", F.coalesce(_block(ts, block_days), F.lit(-(1 << 40))))
    within = Window.partitionBy(key, "_block").orderBy(ts, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(F.col(key).alias("_k"), F.col("_block").alias("_b")).agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    offsets = totals.select("_k", "_b", *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums))
    summed = cut.select("_block", *own, *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(c) for c in sums))
    both = summed.join(offsets, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")))
    return both.select(*own, *((F.col(c) + F.col(f"_o_{c}")).alias(c) for c in sums))


def covering(points: DataFrame, intervals: DataFrame, key: str, ts: str, values: dict[str, Column], start: str = "t0", end: str = "t1", closed: bool = True, block_days: int | None = None) -> DataFrame:
    """For each point the sums of values over the intervals that cover it.

    points: key, ts and others; intervals: key, start, end (null: without end). Both ends
    belong to an interval if closed, else the end does not.
    """
    begin_at, point_at, end_at = (0, 1, 2) if closed else (1, 2, 0)
    names = list(values)
    zero = {n: F.lit(0.0) for n in names}
    own = [c for c in points.columns if c not in (key, ts)]
    none = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in own]
    opened = intervals.select(F.col(key), F.col(start).alias(ts), F.lit(begin_at).alias("_kind"), *(values[n].cast("double").alias(n) for n in names), *none)
    closed_ = intervals.where(F.col(end).isNotNull()).select(F.col(key), F.col(end).alias(ts), F.lit(end_at).alias("_kind"), *((-values[n]).cast("double").alias(n) for n in names), *none)
    at = points.select(key, ts, F.lit(point_at).alias("_kind"), *(zero[n].alias(n) for n in names), *own)
    line = opened.unionByName(closed_).unionByName(at)
    return running_sums(line, key, ts, names, block_days).where(F.col("_kind") == point_at).select(key, ts, *own, *names)


def between(points: DataFrame, intervals: DataFrame, key: str, ts: str, values: dict[str, Column], start: str = "t0", end: str = "t1", block_days: int | None = None) -> DataFrame:
    """The intervals with n_points and the sums of values over points in [start, end].

    By differences of running sums; a null end reaches to the last point.
    """
    names = list(values)
    own = [c for c in intervals.columns if c != key]
    tagged = intervals.withColumn("_id", F.struct(*own))
    far = F.coalesce(F.col(end), F.to_timestamp_ntz(F.lit("9999-01-01 00:00:00")))
    null_id = F.lit(None).cast(tagged.schema["_id"].dataType)
    empty = [F.lit(None).cast("double").alias(f"_{n}") for n in names]
    line = (
        points.select(key, ts, F.lit(1).alias("_kind"), F.lit(1).alias("_one"), *(values[n].cast("double").alias(f"_{n}") for n in names), null_id.alias("_id"))
        .unionByName(tagged.select(key, F.col(start).alias(ts), F.lit(0).alias("_kind"), F.lit(0).alias("_one"), *empty, "_id"))
        .unionByName(tagged.select(key, far.alias(ts), F.lit(2).alias("_kind"), F.lit(0).alias("_one"), *empty, "_id"))
    )
    summed = running_sums(line, key, ts, ["_one", *(f"_{n}" for n in names)], block_days).where(F.col("_kind") != 1)
    sign = F.when(F.col("_kind") == 2, 1).otherwise(-1)
    # repeated intervals stay as often as they are there
    out = summed.groupBy(key, "_id").agg(F.sum(F.when(F.col("_kind") == 2, 1).otherwise(0)).alias("_times"), F.sum(sign * F.col("_one")).alias("_n"), *(F.sum(sign * F.col(f"_{n}")).alias(f"_d_{n}") for n in names))
    out = out.withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("_times").cast("int"))))
    return out.select(key, *(F.col(f"_id.{c}").alias(c) for c in own), (F.col("_n") / F.col("_times")).cast("bigint").alias("n_points"), *((F.col(f"_d_{n}") / F.col("_times")).alias(n) for n in names))


def inside(points: DataFrame, intervals: DataFrame, key: str, ts: str, start: str = "t0", end: str = "t1", bucket_days: int = 1) -> DataFrame:
    """All pairs of an interval and a point of its series in [start, end], with the columns of both.

    A null end reaches to the last point. Points must not share column names with the
    intervals, except the key.
    """
    ends = points.groupBy(key).agg(F.max(ts).alias("_last"))
    spread = intervals.join(ends, key).withColumn("_end", F.least(F.coalesce(F.col(end), F.col("_last")), F.col("_last"))).where(F.col(start) <= F.col("_end"))
    spread = spread.withColumn("_bucket", F.explode(F.sequence(_block(start, bucket_days), _block("_end", bucket_days))))
    at = points.withColumn("_bucket", _block(ts, bucket_days))
    return spread.join(at, [key, "_bucket"]).where(F.col(ts).between(F.col(start), F.col("_end"))).drop("_bucket", "_end", "_last")
