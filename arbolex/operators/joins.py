"""Equi-joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolex.session import materialize

# At most this many hot keys are broadcast; any other key holds less than 1/HOT_KEYS of the rows.
HOT_KEYS = 10_000

# A table is broadcast only if it was counted to have no more rows than this.
SMALL_ROWS = 200_000


def if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is for a shuffle join.

    The check reads ``df``: hand over a written table where that is dear.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hottest(counts: DataFrame, keys: Sequence[str], n: str = "n", limit: int = HOT_KEYS) -> DataFrame:
    """The ``limit`` most frequent keys, an upper bound on what a broadcast may hold.

    Written out, since a hot join reads them three times.
    """
    return materialize(counts.orderBy(F.col(n).desc(), *keys).limit(limit).select(*keys), "hot-keys")


def hot_join(left: DataFrame, right: DataFrame, on: Sequence[str], hot: DataFrame, how: str = "left") -> DataFrame:
    """``left`` join ``right`` (unique on ``on``): hot keys by broadcast, the rest by shuffle.

    ``hot`` holds a bounded number of keys. The two halves are disjoint, so nothing is lost
    and no key is joined twice.
    """
    on = list(on)
    keys = F.broadcast(hot.select(*on))
    hot_half = left.join(F.broadcast(hot.select(*on).join(right, on, how)), on, "inner")
    cold_half = left.join(keys, on, "left_anti").join(right.join(keys, on, "left_anti"), on, how)
    return hot_half.unionByName(cold_half)
