"""Row numbers and running totals without a single-task window.

``row_number()`` over a whole table, or over one hot group, puts all its rows into one task.
Here the rows are range-sorted, written once with ``monotonically_increasing_id`` and then
numbered from one small row per (group, sorted partition). ``order`` must be a total order
inside each group, so no key value can fill a partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbolex.session import materialize


def number_rows(
    df: DataFrame,
    order: Sequence[str | Column],
    by: Sequence[str] = (),
    name: str = "rn",
    group_size: str | None = None,
    running: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in ``order`` inside its ``by`` group.

    ``group_size`` names a column for the number of rows in the group; ``running`` maps new
    column -> value column for running sums in the same order.
    """
    running = dict(running or {})
    by = list(by)
    rows = materialize(
        df.orderBy(*by, *order).withColumn("_mid", F.monotonically_increasing_id()), "numbered"
    ).withColumn("_part", F.shiftright("_mid", 33))

    parts = rows.groupBy(*by, "_part").agg(
        F.min("_mid").alias("_first"),
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(v).alias(f"_sum_{k}") for k, v in running.items()],
    )
    # one row per sorted partition and group: small whatever the number of rows
    group = Window.partitionBy(*by)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *by,
        "_part",
        "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_off_{k}") for k in running],
        *([F.sum("_rows").over(group).alias(group_size)] if group_size else []),
    )
    if not by:
        offsets = F.broadcast(offsets)  # as many rows as sorted partitions
    out = rows.join(offsets, [*by, "_part"]).withColumn(
        name, F.col("_mid") - F.col("_first") + F.col("_before") + 1
    )
    if running:
        inside = Window.partitionBy(*by, "_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
        for k, v in running.items():
            out = out.withColumn(k, F.sum(v).over(inside) + F.col(f"_off_{k}"))
    return out.drop("_mid", "_part", "_first", "_before", *[f"_off_{k}" for k in running])


def number_small(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Plain row numbers for a table whose size is bounded by a parameter or by the alphabet."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
