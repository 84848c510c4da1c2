"""The first row of a series, from a place on, at which a price passes a bound.

An index over the series holds, for blocks of ``FAN`` rows, for blocks of these blocks and so on,
their least and greatest price. A search looks at the rest of its own block, then at the blocks
after it, then at the blocks of blocks, until one holds a price that passes; then it goes down
again, block by block, to the first such row. Every step is a join with one block, so that a search
costs the height of the index, not the length of its path, and a long series is dealt out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

BITS = 7
FAN = 1 << BITS


def _index(path: DataFrame, key: str, levels: int) -> list[DataFrame]:
    """For each level key, _g (number of the block) and _c: its children in order, each with place, first time, least and greatest price."""
    out = []
    below = path.select(F.col(key), F.col("_rank").alias("i"), F.col("ts").alias("at"), F.col("price").alias("lo"), F.col("price").alias("hi"))
    for _ in range(levels):
        block = below.groupBy(key, F.shiftright("i", BITS).alias("_g")).agg(
            F.sort_array(F.collect_list(F.struct("i", "at", "lo", "hi"))).alias("_c"), F.min("at").alias("_at"), F.min("lo").alias("_lo"), F.max("hi").alias("_hi")
        )
        block = written(block, "extrema") if levels > 1 else block  # a single level is read once
        out.append(block.select(key, "_g", "_c"))
        below = block.select(F.col(key), F.col("_g").alias("i"), F.col("_at").alias("at"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))
    return out


def first_crossing(path: DataFrame, searches: DataFrame, passes: Callable[[Column], Column], key: str = "series_id") -> DataFrame:
    """The searches with _hit: the time of the first row from place _from on, and not after _until, whose price passes.

    path: key, ts, price (null: none) and _rank, its place in the series. passes(price) may use the
    columns of searches and must be monotone in the price, up or down: then a block holds a price that
    passes only if its least or greatest does. A null _from finds nothing, a null _until is without end.
    """
    longest = path.agg(F.max("_rank")).first()[0]
    levels = 1
    while longest is not None and longest >> (BITS * levels):
        levels += 1
    index = _index(path, key, levels)
    # a search is on its way up until it has found a block at some level; then _level says which, and _node its number
    rows = searches.withColumns({"_i": F.col("_from"), "_up": F.col("_from").isNotNull(), "_level": F.lit(-1), "_node": F.lit(None).cast("long"), "_hit": F.lit(None).cast(path.schema["ts"].dataType)})

    def look(rows: DataFrame, level: int, active: Column, block: Column, least: Column | None) -> DataFrame:
        # those that look at nothing here are spread over numbers that no block has
        asked = rows.withColumn("_g", F.when(active, block).otherwise(-1 - F.pmod(F.hash(key, "_from"), F.lit(100_000)).cast("long")))
        there = lambda c: F.coalesce((c["at"] <= F.col("_until")) | F.col("_until").isNull(), F.lit(False)) & (passes(c["lo"]) | passes(c["hi"]))
        found = F.filter("_c", there if least is None else lambda c: (c["i"] >= least) & there(c))
        return asked.join(index[level], [key, "_g"], "left").withColumn("_found", F.get(found, F.lit(0))).drop("_g", "_c")

    def settled(rows: DataFrame, level: int, active: Column, **others: Column) -> DataFrame:
        hit = active & F.col("_found").isNotNull()
        new = {
            "_hit": F.when(hit, F.col("_found.at")).otherwise(F.col("_hit")) if level == 0 else F.col("_hit"),
            "_level": F.when(hit, F.lit(level)).when(active, F.lit(-1)).otherwise(F.col("_level")),
            "_node": F.when(hit, F.col("_found.i")).otherwise(F.col("_node")),
        }
        return rows.withColumns(new | others).drop("_found")

    for level in range(levels):
        up = F.col("_up")
        rows = look(rows, level, up, F.shiftright("_i", BITS), F.col("_i"))
        going = up & F.col("_found").isNull()
        rows = settled(rows, level, up, _up=going, _i=F.when(going, F.shiftright("_i", BITS) + 1).otherwise(F.col("_i")))
    for level in range(levels - 2, -1, -1):
        down = F.col("_level") == level + 1
        rows = settled(look(rows, level, down, F.col("_node"), None), level, down)
    return rows.drop("_i", "_up", "_level", "_node")
