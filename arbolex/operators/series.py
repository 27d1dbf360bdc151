"""Running average of a loss series: cumulative mean at first, exponential average afterwards.

Values are numbered per series without a single-task window and cut into chunks. Inside a chunk the
average is a weighted running sum; between chunks it is a carry. The chunk length is chosen so that
the weight over ``CARRIES`` chunks is below the smallest double, so older chunks add exactly nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbolex.operators.joins import hot_join, hottest
from arbolex.operators.numbering import number_rows

WARM, DECAY = 100, 0.99
PARSER_WARM, PARSER_DECAY = 1000, 0.999
# Weight left after one chunk; CARRIES chunks give 1e-360, which is 0 as a double.
CHUNK_WEIGHT = 1e-90
CARRIES = 4


def running_loss(
    values: DataFrame,
    warm: int = WARM,
    decay: float = DECAY,
    start: DataFrame | None = None,
    chunk: int | None = None,
    carries: int = CARRIES,
) -> DataFrame:
    """``series, ord, k, loss, avg_loss`` for a table ``series, ord, loss`` (``ord`` unique per series).

    Row ``k`` below ``warm`` has the mean so far, later rows ``decay * previous + (1 - decay) * loss``.
    ``start`` (``series, k0, avg0``) continues earlier runs.
    """
    size = chunk or int(math.log(CHUNK_WEIGHT) / math.log(decay))
    rows = number_rows(values, ["ord"], by=["series"], name="_rn")
    if start is None:
        rows = rows.withColumn("k0", F.lit(0)).withColumn("avg0", F.lit(0.0))
    else:
        known = start.select("series", F.col("k0").cast("bigint").alias("k0"), "avg0")
        sizes = values.groupBy("series").agg(F.count(F.lit(1)).alias("n"))
        rows = hot_join(rows, known, ["series"], hottest(sizes, ["series"])).fillna({"k0": 0, "avg0": 0.0})
    rows = rows.withColumn("k", F.col("_rn") + F.col("k0"))

    # mean part: at most warm - 1 rows per series
    order = Window.partitionBy("series").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    mean = rows.where(F.col("k") < warm).withColumn(
        "avg_loss", (F.col("avg0") * F.col("k0") + F.sum("loss").over(order)) / F.col("k")
    )

    # decayed part: index m counts from the first decayed row of this run
    tail = rows.where(F.col("k") >= warm)
    tail = tail.withColumn("m", F.col("k") - F.greatest(F.lit(warm), F.col("k0") + 1))
    tail = tail.withColumn("c", F.floor(F.col("m") / size)).withColumn("o", (F.col("m") % size).cast("double"))
    inside = Window.partitionBy("series", "c").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    weighted = F.col("loss") * F.pow(F.lit(decay), -F.col("o"))
    tail = tail.withColumn(
        "local", (1 - decay) * F.pow(F.lit(decay), F.col("o")) * F.sum(weighted).over(inside)
    )
    ends = tail.groupBy("series", "c").agg(F.max_by("local", "o").alias("end"))
    # what the series starts from counts as the end of a chunk before the first
    before = F.lit(-1).cast("bigint").alias("c")
    from_mean = mean.groupBy("series").agg(F.max_by("avg_loss", "k").alias("end"))
    from_start = tail.where((F.col("m") == 0) & (F.col("k0") >= warm - 1)).select("series", before, "avg0")
    seeds = from_mean.select("series", before, "end").unionByName(from_start.withColumnRenamed("avg0", "end"))
    ends = ends.unionByName(seeds)

    # each chunk end reaches the next few chunks with a shrinking weight
    reach = F.explode(F.sequence(F.lit(1), F.lit(carries)))
    carried = (
        ends.select("series", (F.col("c")).alias("from_c"), "end", reach.alias("ahead"))
        .select(
            "series",
            (F.col("from_c") + F.col("ahead")).alias("c"),
            (F.col("end") * F.pow(F.lit(decay), (F.col("ahead") - 1) * float(size))).alias("part"),
        )
        .groupBy("series", "c")
        .agg(F.sum("part").alias("carry"))
    )
    out = tail.join(carried, ["series", "c"], "left").withColumn(
        "avg_loss",
        F.col("local") + F.pow(F.lit(decay), F.col("o") + 1) * F.coalesce("carry", F.lit(0.0)),
    )
    final = ["series", "ord", "k", "loss", "avg_loss"]
    return mean.select(*final).unionByName(out.select(*final))
