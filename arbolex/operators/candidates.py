"""Beam arithmetic over a table of candidates: top-k, gold candidate, log-sum-exp and beam loss."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 64


def best_first() -> list[Column]:
    return [F.col("score").desc(), F.col("parent"), F.col("move")]


def top_k(candidates: DataFrame, k: int, by: str = "sent_id") -> DataFrame:
    """The ``k`` best candidates per sentence, ties by parent and move: adds ``slot`` from 1.

    The rank filter is pushed below the shuffle, so a hot sentence sends at most ``k`` rows per task.
    """
    ranked = candidates.withColumn("slot", F.row_number().over(Window.partitionBy(by).orderBy(*best_first())))
    return ranked.where(F.col("slot") <= k)


def logsumexp(values: DataFrame, by: Sequence[str], value: str = "score", name: str = "logsumexp") -> DataFrame:
    """Stable ``log(sum(exp(x)))`` per group in mergeable parts.

    Values are summed relative to the lower end of their 64-wide bin, which cannot overflow; only
    one row per bin meets in the final step.
    """
    bins = (
        values.withColumn("_bin", F.floor(F.col(value) / BIN))
        .groupBy(*by, "_bin")
        .agg(F.sum(F.exp(F.col(value) - F.col("_bin") * BIN)).alias("_part"))
    )
    topped = bins.withColumn("_top", F.max("_bin").over(Window.partitionBy(*by)))
    scaled = F.col("_part") * F.exp(((F.col("_bin") - F.col("_top")) * BIN).cast("double"))
    return topped.groupBy(*by).agg((F.max("_top") * BIN + F.log(F.sum(scaled))).alias(name))


def gold_candidate(candidates: DataFrame, by: str = "sent_id") -> DataFrame:
    """First parent whose path is still gold and its first zero-cost move; no row when there is none."""
    gold_parent = F.col("parent_cost") == 0
    picked = candidates.groupBy(by).agg(
        F.min(F.when(gold_parent, F.col("parent"))).alias("first_parent"),
        F.min(F.when(gold_parent & (F.col("move_cost") == 0), F.struct("parent", "move", "score"))).alias("gold"),
    )
    return picked.where(F.col("gold.parent") == F.col("first_parent")).select(
        by, F.col("gold.parent").alias("parent"), F.col("gold.move").alias("move"), F.col("gold.score").alias("score")
    )


def beam_loss(candidates: DataFrame, k: int, by: str = "sent_id") -> DataFrame:
    """``early_stop`` and loss of a beam step: log-sum-exp over the beam minus the gold score.

    Gold is the best member of the beam that has cost nothing so far. Where there is none the step stops early: gold
    is the first free move of the first free parent, and it joins the beam in the sum. A step that neither stops early
    nor ends the sentence (``is_final``; where that column is absent, every step does) has loss 0. Sentences without
    any free candidate have no row.
    """
    beam = top_k(candidates if "is_final" in candidates.columns else candidates.withColumn("is_final", F.lit(True)), k, by)
    free = F.col("parent_cost") + F.col("move_cost") == 0
    held = beam.groupBy(by).agg(
        F.min(F.when(free, F.struct("slot", "score"))).alias("held"), F.max("is_final").alias("is_final")
    )
    fallen = gold_candidate(candidates, by).select(by, F.col("score").alias("fallen_score"))
    gold = (
        held.join(fallen, by, "left")
        .select(by, "is_final", F.col("held").isNull().alias("early_stop"),
                F.coalesce("held.score", "fallen_score").alias("gold_score"))
        .where(F.col("gold_score").isNotNull())
    )
    pool = beam.select(by, "score").unionByName(gold.where("early_stop").select(by, F.col("gold_score").alias("score")))
    loss = F.when(F.col("early_stop") | F.col("is_final"), F.col("logsumexp") - F.col("gold_score")).otherwise(F.lit(0.0))
    return gold.join(logsumexp(pool, [by]), by).select(by, "early_stop", loss.alias("loss"))
