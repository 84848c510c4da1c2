"""What the query modules share: rounding, common table expressions, the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def r6(x: Column | str, digits: int = 6) -> Column:
    """Rounded, without negative zero; scaled and rounded as doubles, as the SQL does it, not by decimal digits: at a half the last bit decides."""
    scale = F.lit(10.0**digits)
    return F.round((F.col(x) if isinstance(x, str) else x).cast("double") * scale) / scale + F.lit(0.0)


def rounded(df: DataFrame, *keep: str, digits: int = 6, **values: Column | str) -> DataFrame:
    """The columns to keep and rounded values under their names."""
    return df.select(*keep, *(r6(v, digits).alias(n) for n, v in values.items()))


def sql6(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0::DOUBLE)"


#: Series of the test tables, as table expressions.
BY_USER = "p AS (SELECT user_id AS series_id, ts, event_id AS seq, value AS close FROM events)"
BY_TYPE = "p AS (SELECT event_type AS series_id, ts, event_id AS seq, value AS close FROM events)"
BARS = """b AS (SELECT event_type AS series_id, date_trunc('day', ts)::TIMESTAMP AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
    arg_max(value, ts) AS close, count(*)::DOUBLE AS volume, sum(value) AS dollar_volume FROM events GROUP BY 1, 2)"""
TICK_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"
TICKS = """t AS (SELECT l_returnflag AS series_id, l_shipdate AS ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity AS price, l_quantity AS size,
    l_extendedprice AS dollars, l_extendedprice / l_quantity * (1 - l_discount / 100) AS bid, l_extendedprice / l_quantity * (1 + l_tax / 100) AS ask, l_extendedprice / l_quantity AS last FROM lineitem)"""


class Registry:
    """Queries and their SQL by name."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is registered already")
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return put
