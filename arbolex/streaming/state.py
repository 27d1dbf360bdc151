"""Stateful streams whose state is a written table per epoch.

A keyed state store keeps all rows of a key in one task, and a single length or series may hold a
large part of the stream. Here each micro-batch is an ordinary distributed job: it reads the state
of the epoch before, runs the batch operator and writes its own state. A repeated epoch replaces
its own folders, so results stay exact after a restart.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbolex.operators.batching import BATCH, SEED, slots
from arbolex.operators.joins import if_small
from arbolex.operators.numbering import number_rows
from arbolex.operators.series import running_loss
from arbolex.session import materialize
from arbolex.streaming.source import drain_triggers, stream_line_counts
from arbolex.streaming.text import drain, stream_tokens

#: lengths that must have a full batch, or the buckets are refilled
READY = 10

BATCH_ROW = "epoch_in bigint, file string, start bigint, nth bigint, line string, words array<string>, seq_len int"
CARRY_ROW = "series string, k0 bigint, avg0 double"


def arrivals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``own``: the number, from 1, of a line among those of its stretch (``file, start``) and length in this task."""
    seen: dict[tuple, int] = {}
    for batch in batches:
        length = batch.column("seq_len").to_numpy(zero_copy_only=False)
        file, start = batch.column("file").dictionary_encode(), batch.column("start").to_numpy(zero_copy_only=False)
        names, which = file.dictionary.to_pylist(), file.indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(which, append=-1) | np.diff(start, append=-1)) + 1
        own = np.empty(len(length), np.int64)
        for first, last in zip([0, *cuts[:-1]], cuts, strict=True):
            part = length[first:last]
            order = np.argsort(part, kind="stable")
            values, begins, counts = np.unique(part[order], return_index=True, return_counts=True)
            place = (names[which[first]], int(start[first]))
            before = np.array([seen.get((*place, int(v)), 0) for v in values], np.int64)
            own[first + order] = np.arange(1, last - first + 1) + np.repeat(before - begins, counts)
            seen.update(((*place, int(v)), int(x)) for v, x in zip(values, before + counts, strict=True))
        yield batch.append_column("own", pa.array(own))


def batch_writer(path: str, size: int = BATCH):
    """Length-bucket batching: full batches leave, the rest waits in the state table.

    At most ``size - 1`` lines wait per length. Lines keep their order of arrival. No line is shuffled or sorted: a task
    numbers the lines of its stretches of the files by length, and a small table, a row for each stretch and length, tells how
    many come before.
    """

    def write(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        fresh = df.select(
            F.lit(epoch).cast("bigint").alias("epoch_in"), "file", "start", F.spark_partition_id().alias("task"), "line", "words",
            (F.col("n") + 2).cast("int").alias("seq_len"),
        )
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fresh.schema.fields)
        rows = materialize(fresh.mapInArrow(arrivals, f"{kinds}, own bigint"), "arrived")
        # the order of arrival inside a stretch and length
        rows = rows.withColumn("nth", F.shiftleft(F.col("task").cast("bigint"), 33) + F.col("own"))
        stretch = ["file", "start", "task", "seq_len"]
        counts = rows.groupBy(*stretch).agg(F.count(F.lit(1)).alias("_rows"))
        length = Window.partitionBy("seq_len")
        before = F.coalesce(F.sum("_rows").over(length.orderBy("file", "start", "task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.select(*stretch, before.alias("_before"), F.sum("_rows").over(length).alias("_fresh"))
        numbered = None
        if epoch > 0:
            # fewer lines than a batch wait for each length, so the window is small
            waiting = spark.read.schema(BATCH_ROW).parquet(f"{path}/waiting/{epoch - 1}")
            waiting = waiting.withColumn("_rn", F.row_number().over(length.orderBy("epoch_in", "file", "start", "nth")).cast("bigint"))
            held = waiting.groupBy("seq_len").agg(F.count(F.lit(1)).alias("_held"))
            come = counts.groupBy("seq_len").agg(F.first("_fresh").alias("_fresh"))
            numbered = waiting.join(held, "seq_len").join(come, "seq_len", "left").withColumn("_size", F.col("_held") + F.coalesce("_fresh", F.lit(0)))
            counts = counts.join(held, "seq_len", "left")
        else:
            counts = counts.withColumn("_held", F.lit(0).cast("bigint"))
        counts = if_small(materialize(counts.withColumn("_held", F.coalesce("_held", F.lit(0))), "stretches"))
        placed = rows.join(counts, stretch).withColumns(
            {"_rn": F.col("_held") + F.col("_before") + F.col("own"), "_size": F.col("_held") + F.col("_fresh")}
        )
        columns = ["epoch_in", "file", "start", "nth", "line", "words", "seq_len", "_rn", "_size"]
        placed = placed.select(*columns)
        if numbered is not None:
            placed = placed.unionByName(numbered.select(*columns))
        full = F.col("_rn") <= F.floor(F.col("_size") / size) * size
        number, slot = slots(F.col("_rn"), size)
        placed.where(full).select(
            "seq_len", number.alias("batch_no"), slot.alias("slot"), "line", "words"
        ).write.mode("overwrite").parquet(f"{path}/batches/epoch={epoch}")
        placed.where(~full).drop("_rn", "_size").write.mode("overwrite").parquet(f"{path}/waiting/{epoch}")

    return write


def stream_batches(tokens: DataFrame, path: str, size: int = BATCH) -> DataFrame:
    """Run the batching over all available lines: ``epoch, seq_len, batch_no, slot, line, words``."""
    drain(tokens, f"{path}/checkpoint", batch_writer(path, size))
    return tokens.sparkSession.read.parquet(f"{path}/batches")


def draw_plan(sizes: dict[int, int], drawn: int, forced: bool, size: int, ready: int, seed: int, last: bool) -> list[int]:
    """The lengths that are drawn one after the other from buckets of the given sizes.

    While at least ``ready`` lengths have a full batch one of those is drawn, by a hash of the draw's number; below that
    the buckets are refilled first, so a plan made after a refill (``forced``) draws once all the same. When nothing more
    comes (``last``) the draws go on to the last full batch. Only the sizes by length are needed, a bounded number.
    """
    sizes, out = dict(sizes), []
    while True:
        full = sorted(length for length, n in sizes.items() if n >= size)
        if not full or not (len(full) >= ready or last or (forced and not out)):
            return out
        pick = full[int(hashlib.md5(f"{drawn + len(out)}:{seed}".encode()).hexdigest()[:8], 16) % len(full)]
        sizes[pick] -= size
        out.append(pick)


WAITING = "epoch_in bigint, file string, line_no bigint, line string, words array<string>, seq_len int"
DRAWN = "seq_len int, take bigint, draw bigint"


def _draw(waiting: DataFrame, path: str, epoch: int, size: int, ready: int, seed: int, last: bool) -> None:
    """Draw batches from what waits and write them, what is left, and the number of draws so far, for ``epoch``."""
    spark = waiting.sparkSession
    rows = materialize(number_rows(waiting, ["epoch_in", "file", "line_no"], by=["seq_len"], name="_rn"), "arrived")
    sizes = {r["seq_len"]: r["n"] for r in rows.groupBy("seq_len").agg(F.max("_rn").alias("n")).collect()}
    before = spark.read.schema("draws bigint").parquet(f"{path}/draws/{epoch - 1}").first()["draws"] if epoch else 0
    plan = draw_plan(sizes, before, epoch > 0, size, ready, seed, last)
    taken: Counter[int] = Counter()
    drawn = []
    for k, length in enumerate(plan):
        drawn.append((length, taken[length], before + k))
        taken[length] += 1
    draws = F.broadcast(spark.createDataFrame(drawn, DRAWN))  # no more than the sequences of a trigger by the batch size
    number, slot = slots(F.col("_rn"), size)
    rows = rows.withColumn("take", number).withColumn("slot", slot).join(draws, ["seq_len", "take"], "left")
    full = F.col("draw").isNotNull()
    rows.where(full).select("draw", "seq_len", "slot", "line", "words").write.mode("overwrite").parquet(f"{path}/batches/epoch={epoch}")
    rows.where(~full).select(*waiting.columns).write.mode("overwrite").parquet(f"{path}/waiting/{epoch}")
    spark.createDataFrame([(before + len(plan),)], "draws bigint").write.mode("overwrite").parquet(f"{path}/draws/{epoch}")


def refill_writer(path: str, size: int = BATCH, ready: int = READY, seed: int = SEED):
    """Batches drawn from length buckets that each micro-batch refills, see :func:`draw_plan`.

    The buckets are a table per epoch, with the lines in order of arrival, so a length that holds most of the stream is
    spread like any other rows. A repeated epoch replaces itself.
    """

    def write(df: DataFrame, epoch: int) -> None:
        fresh = df.select(
            F.lit(epoch).cast("bigint").alias("epoch_in"), "file", "line_no", "line", "words", (F.col("n") + 2).cast("int").alias("seq_len")
        )
        if epoch > 0:
            fresh = df.sparkSession.read.schema(WAITING).parquet(f"{path}/waiting/{epoch - 1}").unionByName(fresh)
        _draw(fresh, path, epoch, size, ready, seed, last=False)

    return write


def stream_draws(
    spark: SparkSession, folder: str, path: str, intake: Sequence[int], longest: int | None = None, size: int = BATCH,
    ready: int = READY, seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """Run the refill rule over the lines of a folder: (``draw, seq_len, slot, line, words``, what is left).

    ``intake`` is the number of lines of the first, second ... refill. When the lines are used up the remaining full
    batches are drawn; fewer than ``size`` lines of a length are left.
    """
    lines = stream_line_counts(spark, folder, intake, f"{path}/checkpoint", longest)
    seen: list[int] = []
    write = refill_writer(path, size, ready, seed)

    def noted(df: DataFrame, epoch: int) -> None:
        write(df, epoch)
        seen.append(epoch)

    drain_triggers(stream_tokens(lines), f"{path}/checkpoint", noted)
    if seen:
        _draw(spark.read.schema(WAITING).parquet(f"{path}/waiting/{seen[-1]}"), path, seen[-1] + 1, size, ready, seed, last=True)
        left = spark.read.schema(WAITING).parquet(f"{path}/waiting/{seen[-1] + 1}")
        return spark.read.parquet(f"{path}/batches"), left
    empty = spark.createDataFrame([], "draw bigint, seq_len int, slot int, line string, words array<string>")
    return empty, spark.createDataFrame([], WAITING)


def loss_writer(path: str, warm: int, decay: float):
    """Running loss that goes on where the epoch before ended."""

    def write(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        start = None
        if epoch > 0:
            start = spark.read.schema(CARRY_ROW).parquet(f"{path}/carry/{epoch - 1}")
        rows = materialize(running_loss(df, warm, decay, start), "losses")
        rows.write.mode("overwrite").parquet(f"{path}/losses/epoch={epoch}")
        carry = rows.groupBy("series").agg(
            F.max("k").alias("k0"), F.max_by("avg_loss", "k").alias("avg0")
        )
        if start is not None:
            silent = start.join(carry.select("series"), "series", "left_anti")
            carry = carry.unionByName(silent.select("series", "k0", "avg0"))
        carry.write.mode("overwrite").parquet(f"{path}/carry/{epoch}")

    return write


def stream_running_loss(values: DataFrame, path: str, warm: int, decay: float) -> DataFrame:
    """Running loss of a stream of ``series, ord, loss``; ``ord`` must grow from epoch to epoch."""
    drain(values, f"{path}/checkpoint", loss_writer(path, warm, decay))
    return values.sparkSession.read.parquet(f"{path}/losses")
