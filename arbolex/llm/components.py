"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolex.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, root) for every end of an edge: the smallest vertex that it is connected with.

    Each step takes the smallest label among the neighbours and then the label's own label, so a component of
    diameter d settles in about log d steps; labels are written out after each step. An end that many edges share is
    aggregated before the shuffle, and split in the joins by adaptive execution.
    """
    both = edges.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v is not null and u is not null")
    both = materialize(both.unionByName(both.select(F.col("u").alias("v"), F.col("v").alias("u"))), "edges")
    labels = materialize(
        both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("root")), "labels"
    )
    while True:
        of = labels.select(F.col("v").alias("u"), F.col("root").alias("other"))
        nearest = both.join(of, "u").groupBy("v").agg(F.min("other").alias("other"))
        # a vertex also tells its root about the labels it hears of
        told = nearest.join(labels, "v")
        offers = told.select("v", F.least("root", "other").alias("offer")).unionByName(
            told.select(F.col("root").alias("v"), F.least("root", "other").alias("offer"))
        )
        hooked = offers.groupBy("v").agg(F.min("offer").alias("offer"))
        jump = hooked.select(F.col("v").alias("offer"), F.col("offer").alias("next"))
        new = materialize(
            hooked.join(jump, "offer", "left").select("v", F.coalesce("next", "offer").alias("root")), "labels"
        )
        if not new.join(labels.withColumnRenamed("root", "old"), "v").where("root <> old").limit(1).count():
            return new
        labels = new
