"""Unbounded text: tokens and word counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolex.functions.text import split_words
from arbolex.session import new_path


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Text files of a growing folder as a stream: ``file, start, line``; intake per trigger is bounded."""
    reader = spark.readStream.option("lineSep", "\n")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").alias("line"),
    )


def stream_tokens(lines: DataFrame) -> DataFrame:
    """Tokenised lines of a stream."""
    return lines.withColumn("words", split_words(F.col("line"))).withColumn("n", F.size("words"))


def drain(stream: DataFrame, checkpoint: str, write_epoch, mode: str = "append") -> None:
    """Run a stream over all that is available now, one call of ``write_epoch`` per micro-batch."""
    (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write_epoch)
        .start()
        .awaitTermination()
    )


def epoch_writer(path: str):
    """Write each micro-batch to its own folder, so that a repeated epoch replaces itself."""

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def tokens_table(lines: DataFrame, path: str | None = None) -> DataFrame:
    """Tokenise a stream into a parquet table and return the table."""
    spark = lines.sparkSession
    path = path or new_path(spark, "stream-tokens")
    drain(stream_tokens(lines), f"{path}-checkpoint", epoch_writer(path))
    return spark.read.parquet(path)


def stream_word_counts(lines: DataFrame) -> DataFrame:
    """Running word counts; the state is one number per word."""
    words = lines.select(F.explode(split_words(F.col("line"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


#: epochs after which the changed counts are merged into one table
COMPACT = 16
COUNT_ROW = "word string, n bigint"


def newest_counts(spark: SparkSession, path: str, upto: int, every: int = COMPACT) -> DataFrame:
    """Newest count per word up to an epoch: the last merged table and the changes since; counts only grow."""
    merged = (upto + 1) // every * every - 1
    changes = spark.read.schema(f"{COUNT_ROW}, epoch int").parquet(f"{path}/changes")
    rows = changes.where(F.col("epoch").between(merged + 1, upto)).select("word", "n")
    if merged >= 0:
        rows = rows.unionByName(spark.read.schema(COUNT_ROW).parquet(f"{path}/merged/{merged}"))
    return rows.groupBy("word").agg(F.max("n").alias("n"))


def count_writer(path: str, every: int = COMPACT):
    """Write the changed counts of each micro-batch, and every so often a merged table of all words.

    A reader so takes one merged table and less than ``every`` epochs of changes, however long the stream is. A repeated
    epoch replaces its own folders.
    """

    def write(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        df.select("word", "n").write.mode("overwrite").parquet(f"{path}/changes/epoch={epoch}")
        if (epoch + 1) % every == 0:
            before = newest_counts(spark, path, epoch - 1, every)
            fresh = spark.read.schema(COUNT_ROW).parquet(f"{path}/changes/epoch={epoch}")
            rows = before.unionByName(fresh).groupBy("word").agg(F.max("n").alias("n"))
            rows.write.mode("overwrite").parquet(f"{path}/merged/{epoch}")

    return write


def word_count_table(lines: DataFrame, path: str | None = None, every: int = COMPACT) -> DataFrame:
    """Running counts of a stream as a table: the newest count per word."""
    spark = lines.sparkSession
    path = path or new_path(spark, "stream-counts")
    drain(stream_word_counts(lines), f"{path}-checkpoint", count_writer(path, every), mode="update")
    last = spark.read.schema(f"{COUNT_ROW}, epoch int").parquet(f"{path}/changes").agg(F.max("epoch")).first()[0]
    return newest_counts(spark, path, last if last is not None else 0, every)
