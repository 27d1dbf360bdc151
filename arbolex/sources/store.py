"""Saved vocabularies and move models, with the checks made on loading."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolex.functions import text as tx
from arbolex.functions.labels import deprel_dim, upos_dim

META = "vocab_meta"


def save_vocabularies(
    path: str,
    word_vocab: DataFrame,
    char_vocab: DataFrame,
    tags: DataFrame | None = None,
    labels: DataFrame | None = None,
) -> None:
    """Write word and character vocabularies, the reserved symbols and, when given, the tag tables."""
    spark = word_vocab.sparkSession
    word_vocab.write.mode("overwrite").parquet(f"{path}/word_vocab")
    char_vocab.write.mode("overwrite").parquet(f"{path}/char_vocab")
    has = (tags is not None, labels is not None)
    meta = [(tx.SOS, tx.EOS, tx.UNK, tx.SOW, tx.EOW, tx.PAD, *has)]
    names = "sos string, eos string, unk string, sow string, eow string, pad string, has_tags boolean, has_labels boolean"
    spark.createDataFrame(meta, names).write.mode("overwrite").parquet(f"{path}/{META}")
    if tags is not None:
        tags.write.mode("overwrite").parquet(f"{path}/tags")
    if labels is not None:
        labels.write.mode("overwrite").parquet(f"{path}/labels")


def load_vocabularies(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``word_vocab, char_vocab, meta, tags, labels``; missing tag tables are the built-in ones."""
    meta = spark.read.parquet(f"{path}/{META}")
    has = meta.first()
    return {
        "word_vocab": spark.read.parquet(f"{path}/word_vocab"),
        "char_vocab": spark.read.parquet(f"{path}/char_vocab"),
        "meta": meta,
        "tags": spark.read.parquet(f"{path}/tags") if has["has_tags"] else upos_dim(spark),
        "labels": spark.read.parquet(f"{path}/labels") if has["has_labels"] else deprel_dim(spark),
    }


def save_model(path: str, model: PipelineModel, system: str, templates: Sequence[str]) -> None:
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(system, list(templates))], "system string, templates array<string>").write.mode(
        "overwrite"
    ).parquet(f"{path}/settings")


def load_model(
    spark: SparkSession, path: str, system: str | None = None, templates: Sequence[str] | None = None
) -> tuple[PipelineModel, Mapping]:
    """Model and settings; other settings than those it was trained with are an error."""
    saved = spark.read.parquet(f"{path}/settings").select("system", F.col("templates")).first().asDict()
    if system is not None and system != saved["system"]:
        raise ValueError(f"model was trained for {saved['system']}, not {system}")
    if templates is not None and list(templates) != saved["templates"]:
        raise ValueError("model was trained with other feature templates")
    return PipelineModel.load(f"{path}/model"), saved
