"""Levels and threshold of the quality forest over all labelled rows."""

import numpy as np
from pyspark.sql import functions as F

from arbolex.llm import quality


def test_levels_and_threshold_come_from_every_labelled_row(spark):
    """They came from about 10,000 of the labelled rows, and of these from at most 40,000."""
    n = 24_000
    text = F.concat_ws(" ", F.lit("some plain words that any text may hold and more"), F.repeat(F.lit("A! "), (F.col("doc_id") * F.col("doc_id") % 97).cast("int") % 9), F.repeat(F.lit("7"), (F.col("doc_id") % 23_987 / 1000).cast("int")))
    docs = spark.range(n).withColumnRenamed("id", "doc_id").withColumn("text", text)
    quality_of = F.when(F.col("doc_id") % 8 == 0, 0).when(F.col("doc_id") % 1001 == 0, F.lit(None)).otherwise(1)
    labels = docs.select("doc_id", quality_of.alias("quality"))
    forest = quality.fit_forest(docs, labels)
    rows = quality.measured(docs).join(labels, "doc_id").where("quality is not null and not base_failed").collect()
    shares, good = np.array([r.shares for r in rows]), np.array([r.quality == 1 for r in rows])
    assert len(rows) > 15_000
    assert forest.levels.tolist() == np.quantile(shares[good], quality.GOOD_SHARE, axis=0, method="higher").tolist()
    assert forest.threshold == quality.calibrate_scores(forest.scores(shares), good)


def test_order_statistics_and_threshold_against_plain_ones(spark):
    rng = np.random.default_rng(3)
    shares = np.column_stack([rng.random((500, 5)) ** 9, np.zeros(500), rng.integers(0, 3, 500)])
    df = spark.createDataFrame([(x,) for x in shares.tolist()], "shares array<double>")
    for rank in (0, 250, 498, 499):
        assert quality.order_statistics(df, rank, bins=4) == np.sort(shares, 0)[rank].tolist()
    for good in (rng.random(500) < 0.9, np.ones(500, bool), np.zeros(500, bool)):
        scores = np.round(rng.random(500) + ~good, 2)
        rows = spark.createDataFrame([(float(s), bool(g)) for s, g in zip(scores, good)], "score double, good boolean")
        assert quality.threshold(rows) == quality.calibrate_scores(scores, good)
    assert quality.threshold(rows.limit(0)) == 1.0
