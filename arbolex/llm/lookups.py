"""Look-ups in a table of unique keys, whatever the share of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: keys of a join that are met by broadcast
HOT = 1000


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row per key). ``rows`` is read twice: hand over a cheap one.

    The keys of most rows are met by broadcast; outside them no key holds more than 1 / ``HOT`` of the rows. In the
    shuffle of the rest, the rows already met have keys of their own, so they spread evenly.
    """
    hot = rows.groupBy(key).count().orderBy(F.desc("count"), key).limit(HOT).select(key)
    more = [c for c in table.columns if c != key]
    near = F.broadcast(hot.join(table, key, "left").select(F.col(key).alias("_hot"), F.struct(*more).alias("_near")))
    far = table.select(F.struct(F.col(key), F.lit(0).cast("long").alias("k")).alias("_key"), F.struct(*more).alias("_far"))
    met = rows.join(near, F.col(key) == F.col("_hot"), "left")
    apart = F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.lit(0).cast("long"))
    met = met.withColumn("_k", F.struct(F.col(key), F.coalesce(apart, F.xxhash64(*rows.columns).bitwiseOR(F.lit(1).cast("long"))).alias("k")))
    out = met.join(far, F.col("_k") == F.col("_key"), "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(f"_near.{c}"), F.col(f"_far.{c}")).alias(c) for c in more])
