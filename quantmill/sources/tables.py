"""Series, bars, ticks and quotes from the test tables.

Every reader names its columns, so that only those reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import nan_to_null

TICK_ORDER = ("ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_series(spark: SparkSession, sf_dir: str, key: str = "user_id") -> DataFrame:
    """series_id, ts, seq, close: many short series by user_id, or five long ones by event_type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col(key).alias("series_id"), "ts", F.col("event_id").alias("seq"), nan_to_null(F.col("value")).alias("close"))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OHLCV bars of the five event types by day."""
    e = table(spark, sf_dir, "events")
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return e.groupBy(F.col("event_type").alias("series_id"), day.alias("ts")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"),
        F.count("*").cast("double").alias("volume"), F.sum("value").alias("dollar_volume"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades by return flag with the columns that order them; price, size, dollars, bid, ask, last."""
    t = table(spark, sf_dir, "lineitem")
    price = F.try_divide("l_extendedprice", "l_quantity")
    return t.select(
        F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        price.alias("price"), F.col("l_quantity").alias("size"), F.col("l_extendedprice").alias("dollars"),
        (price * (1 - F.col("l_discount") / 100)).alias("bid"), (price * (1 + F.col("l_tax") / 100)).alias("ask"), price.alias("last"),
    )


def asset_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long return matrix: ts (day), asset (event type), ret = change of the day's mean."""
    from pyspark.sql import Window

    w = Window.partitionBy("asset").orderBy("ts")
    return asset_prices(spark, sf_dir).withColumn("ret", F.try_divide(F.col("price"), F.lag("price").over(w)) - 1).where("ret is not null").select("ts", "asset", "ret")


def asset_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long price matrix: ts (day), asset (event type), price (mean of the day)."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("asset")).agg(F.avg("value").alias("price"))


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option inputs S, K, T, r, sigma, q by part."""
    s, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), s.alias("S"), (s * (1 + (size - 25) / 100)).alias("K"), ((size + 1) / 365).alias("T"), F.lit(0.03).alias("r"), (F.lit(0.2) + size / 200).alias("sigma"), F.lit(0.01).alias("q"))


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions from orders and their lines, as far as they end after they begin."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("t0"), F.col("o_custkey").alias("c"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    price = F.try_divide("l_extendedprice", "l_quantity")
    return o.join(li, F.col("k") == F.col("l_orderkey")).where(F.col("l_shipdate") > F.col("t0")).select(
        (F.col("c") % 20).alias("series_id"), "t0", F.col("l_shipdate").alias("t1"), price.alias("open"), (price * (1 - F.col("l_discount") / 2 + F.col("l_tax") / 2)).alias("close"),
        F.col("l_quantity").alias("open_pos"), (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("close_pos"), (price * 0.01).alias("yield"), (price * 0.005).alias("expense"),
        F.when(price < 1000, 1).otherwise(0).alias("label"), (price * 0.93).alias("clean_open"), (price * 0.95).alias("clean_close"),
    )
