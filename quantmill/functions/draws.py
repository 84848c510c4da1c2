"""Seeded draws from hashes: the same for a row wherever and however often it is computed.

A draw depends on a seed, the number of the stream and the row's id only, so a lost
partition comes back with the same values, and SQL can give them too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(seed: int, stream: int, id_: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:{stream}:"), F.col(id_).cast("string")).cast("binary"))


def _share(digest: Column, place: int) -> Column:
    return (F.conv(F.substring(digest, place, 8), 16, 10).cast("double") + 0.5) / 2.0**32


def uniform(seed: int, stream: int, id_: str = "id") -> Column:
    """Between 0 and 1, ends excluded."""
    return _share(_text(seed, stream, id_), 1)


def normal(seed: int, stream: int, id_: str = "id") -> Column:
    """Standard normal, by the polar form of Box and Muller."""
    digest = _text(seed, stream, id_)
    return F.sqrt(-2 * F.log(_share(digest, 1))) * F.cos(2 * math.pi * _share(digest, 9))


def _share_sql(seed: int, stream: int, id_: str, place: int) -> str:
    return f"((('0x' || substr(md5('{seed}:{stream}:' || {id_}::VARCHAR), {place}, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def uniform_sql(seed: int, stream: int, id_: str = "id") -> str:
    return _share_sql(seed, stream, id_, 1)


def normal_sql(seed: int, stream: int, id_: str = "id") -> str:
    return f"(sqrt(-2 * ln({_share_sql(seed, stream, id_, 1)})) * cos({2 * math.pi!r}::DOUBLE * {_share_sql(seed, stream, id_, 9)}))"
