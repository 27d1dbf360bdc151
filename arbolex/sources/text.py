"""Line scans, word-list and count files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolex.functions.text import split_words

# sent_id = document id * LINE_STRIDE + position of the sentence in the document, from 1. A text has less than 2^31
# characters, so its sentences cannot run out of positions.
LINE_STRIDE = 1 << 31


def sentence_id(doc_id, position):
    """Id of the n-th sentence of a document."""
    return doc_id * LINE_STRIDE + position


def text_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep=()) -> DataFrame:
    """One row per line of each document: ``sent_id, doc_id, line_no, line``."""
    exploded = documents.select(
        F.col(id_col).alias("doc_id"), *keep, F.posexplode(F.split(text_col, "\n")).alias("pos", "line")
    )
    line_no = F.col("pos") + 1
    return exploded.select(
        sentence_id(F.col("doc_id"), line_no).alias("sent_id"), "doc_id", *keep, line_no.alias("line_no"), "line"
    )


def read_lines(spark: SparkSession, path) -> DataFrame:
    """Raw lines of text files with a sortable position: ``pos, line``.

    Inside one file block the running id follows the file; blocks are ordered by file and start.
    """
    return (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("start"),
                F.monotonically_increasing_id().alias("nth"),
            ).alias("pos"),
            F.col("value").alias("line"),
        )
    )


def read_counts(spark: SparkSession, path) -> DataFrame:
    """Count file, lines ``"<count> <word>"``: ``pos, n, word``; a bad count is NULL."""
    parts = split_words(F.col("line"))
    return read_lines(spark, path).select(
        "pos",
        F.get(parts, F.lit(0)).try_cast("bigint").alias("n"),
        F.get(parts, F.lit(1)).alias("word"),
    )


def read_words(spark: SparkSession, path) -> DataFrame:
    """Word list: ``pos, word``. Blank lines are skipped, else the first token counts."""
    return first_tokens(read_lines(spark, path))


def first_tokens(lines: DataFrame) -> DataFrame:
    parts = split_words(F.col("line"))
    return lines.select("pos", F.get(parts, F.lit(0)).alias("word")).where(F.col("word").isNotNull())


def write_counts(counts: DataFrame, path: str) -> None:
    """Count file, most frequent first, ties by word."""
    (
        counts.orderBy(F.col("n").desc(), "word")
        .select(F.concat_ws(" ", F.col("n").cast("string"), "word").alias("value"))
        .write.option("lineSep", "\n")
        .text(path)
    )


def write_words(words: DataFrame, path: str) -> None:
    """Word list without counts, most frequent first."""
    (
        words.orderBy(F.col("n").desc(), "word")
        .select(F.col("word").alias("value"))
        .write.option("lineSep", "\n")
        .text(path)
    )
