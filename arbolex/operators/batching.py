"""Length buckets, batches and padded batch tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbolex.functions import arrays as ar
from arbolex.functions import text as tx
from arbolex.operators.encoding import in_order
from arbolex.operators.joins import SMALL_ROWS
from arbolex.operators.numbering import number_rows

BATCH = 25
CORPUS_BATCH = 128
TRAIN_BATCH = 16
SEED = 4
#: words whose spelling is put in place at once
CELLS = 1 << 18


def seeded(key: Column, seed: int = SEED) -> Column:
    """Reproducible stand-in for a random draw: a hash of key and seed."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def slots(rn: Column, size: int) -> tuple[Column, Column]:
    """Batch number and slot of the 1-based row ``rn``, both from 0."""
    return F.floor((rn - 1) / size).cast("bigint"), ((rn - 1) % size).cast("int")


def ready_buckets(seqs: DataFrame, size: int = BATCH) -> DataFrame:
    """Length buckets that can give at least one full batch: ``seq_len, n_seq, n_batches``."""
    counts = seqs.groupBy("seq_len").agg(F.count(F.lit(1)).alias("n_seq"))
    return counts.where(F.col("n_seq") >= size).withColumn(
        "n_batches", F.floor(F.col("n_seq") / size).cast("bigint")
    )


def pick_bucket(buckets: DataFrame, seed: int = SEED) -> DataFrame:
    """One pseudo-random ready bucket."""
    return buckets.agg(F.min_by("seq_len", seeded(F.col("seq_len"), seed)).alias("seq_len"))


def length_batches(seqs: DataFrame, size: int = BATCH, order: str = "sent_id") -> DataFrame:
    """Cut each length bucket into full batches: adds ``batch_no, slot``; the tail is dropped."""
    rows = number_rows(seqs, [order], by=["seq_len"], name="_rn", group_size="_size")
    batch, slot = slots(F.col("_rn"), size)
    return (
        rows.where(F.col("_rn") <= F.floor(F.col("_size") / size) * size)
        .withColumn("batch_no", batch)
        .withColumn("slot", slot)
        .drop("_rn", "_size")
    )


def minibatches(sents: DataFrame, size: int = TRAIN_BATCH) -> DataFrame:
    """Sort by length and cut into chunks; the last, shorter chunk is kept."""
    rows = number_rows(sents, ["n", "sent_id"], name="_rn")
    batch, slot = slots(F.col("_rn"), size)
    return rows.withColumn("batch_no", batch).withColumn("slot", slot).drop("_rn")


def shuffled_batches(batches: DataFrame, seed: int = SEED) -> DataFrame:
    """Batches in seeded random order: ``batch_no, n_sent, position``."""
    sizes = batches.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n_sent"))
    drawn = sizes.withColumn("_draw", seeded(F.col("batch_no"), seed))
    return number_rows(drawn, ["_draw", "batch_no"], name="position").drop("_draw")


def scheduled_batches(batches: DataFrame, seed: int = SEED) -> DataFrame:
    """Full batches of the length buckets in seeded random order: ``seq_len, batch_no, n_sent, position``."""
    sizes = batches.groupBy("seq_len", "batch_no").agg(F.count(F.lit(1)).alias("n_sent"))
    drawn = sizes.withColumn("_draw", seeded(F.concat_ws(":", "seq_len", "batch_no"), seed))
    return number_rows(drawn, ["_draw", "seq_len", "batch_no"], name="position").drop("_draw")


def corpus_batches(sents: DataFrame, size: int = CORPUS_BATCH) -> DataFrame:
    """Consecutive chunks in corpus order with the longest length: adds ``batch_no, slot, max_n``.

    A batch has at most ``size`` rows, so its window is small.
    """
    rows = number_rows(sents, ["sent_id"], name="_rn")
    batch, slot = slots(F.col("_rn"), size)
    numbered = rows.withColumn("batch_no", batch).withColumn("slot", slot).drop("_rn")
    return numbered.withColumn("max_n", F.max("n").over(Window.partitionBy("batch_no")))


def align_right(batches: DataFrame) -> DataFrame:
    """Time step of each token when its batch is right-aligned: ``step = max_n - n + tok_id``."""
    return batches.select(
        "sent_id", "batch_no", "max_n", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("tok_id")
    ).select("sent_id", "batch_no", "tok_id", (F.col("max_n") - F.col("n") + F.col("tok_id")).alias("step"))


def pad_token_batch(batches: DataFrame, sos: int = tx.SOS_ID, eos: int = tx.EOS_ID) -> DataFrame:
    """Bracketed, left-padded id rows with masks; the padding value is ``eos``."""
    width = F.col("max_n") + 2
    ids = ar.bracketed(F.col("ids"), sos, eos)
    return batches.withColumn("width", width).withColumn("mask", ar.mask_left(ids, width)).withColumn(
        "padded", ar.pad_left(ids, width, eos)
    )


def pad_gold_batch(batches: DataFrame, unk: int = tx.UNK_ID) -> DataFrame:
    """Left-padded gold id rows without brackets; the padding value is ``unk``."""
    width = F.col("max_n")
    return batches.withColumn("width", width).withColumn("mask", ar.mask_left(F.col("ids"), width)).withColumn(
        "padded", ar.pad_left(F.col("ids"), width, unk)
    )


def word_batches(spelled: DataFrame, size: int = BATCH) -> DataFrame:
    """Batches of vocabulary entries in id order (ids are dense behind the reserved words)."""
    batch, slot = slots(F.col("id") - tx.N_RESERVED, size)
    rows = spelled.where(F.col("id") > tx.N_RESERVED).withColumn("batch_no", batch).withColumn("slot", slot)
    return rows.withColumn("max_n", F.max(F.size("char_ids")).over(Window.partitionBy("batch_no")))


def pad_char_batch(batches: DataFrame) -> DataFrame:
    """Words of a batch left-padded to the longest, with word marks.

    The mask follows the padding, so an unknown character keeps 1 though its id is the padding id.
    """
    width = F.col("max_n") + 2
    ids = ar.bracketed(F.col("char_ids"), tx.SOW_ID, tx.EOW_ID)
    return batches.withColumn("width", width).withColumn("mask", ar.mask_left(ids, width)).withColumn(
        "padded", ar.pad_left(ids, width, tx.PAD_ID)
    )


def step_words(batches: DataFrame, spelled: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """The words that a batch has at each time step: ``seq_len, batch_no, step, words``, by slot.

    ``batches`` are full length batches with ``seq`` (see ``encode_dual``) or its input ids as ``ids``, ``spelled`` has the
    ``char_ids`` of every input id, each word spelled once; an id that it does not hold is left out. The sequences of a batch
    meet as ids. The first ``limit`` ids are spelled where they meet, a bounded number; only other words are shuffled, by
    themselves.
    """
    kind = spelled.schema["char_ids"].dataType.simpleString()
    known = spelled.select("id", "char_ids").where(F.col("id").between(0, limit)).toArrow()
    last = spelled.agg(F.max("id")).first()[0] or 0
    numbers, chars = (known.column(c).combine_chunks() for c in ("id", "char_ids"))
    places = np.full(min(limit, last) + 1, -1, np.int64)
    places[numbers.to_numpy(zero_copy_only=False)] = np.arange(len(numbers))
    listed = batches.sparkSession.sparkContext.broadcast((places, chars))
    ids = "ids" if "ids" in batches.columns else "seq.in_id"
    rows = batches.select("seq_len", "batch_no", "slot", F.col(ids).alias("ids"))
    wide = rows.groupBy("seq_len", "batch_no").agg(in_order("ids", by="slot").alias("rows"))
    names = ["seq_len", "batch_no", "rows"]
    if last > limit:
        cold = rows.select("seq_len", "batch_no", "slot", F.posexplode("ids").alias("pos", "id")).where(F.col("id") > limit)
        # a word that is not spelled keeps its place
        cold = cold.join(spelled.where(F.col("id") > limit).select("id", "char_ids"), "id", "left")
        packed = F.sort_array(F.collect_list(F.struct("slot", "pos", "char_ids")))
        wide = wide.join(cold.groupBy("seq_len", "batch_no").agg(packed["char_ids"].alias("cold")), ["seq_len", "batch_no"], "left")
        names.append("cold")

    def run(parts):
        places, chars = listed.value
        for batch in parts:
            of_batch = _counts(batch.column("rows"))
            tokens = np.cumsum(np.bincount(np.repeat(np.arange(len(of_batch)), of_batch), _counts(batch.column("rows").flatten()), len(of_batch)))
            start = 0
            while start < len(of_batch):
                done = tokens[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(tokens, done + CELLS, side="right")))
                yield _steps(batch.slice(start, stop - start), places, chars, limit if "cold" in names else None)
                start = stop

    keys = ", ".join(f"{c} {dict(wide.dtypes)[c]}" for c in ("seq_len", "batch_no"))
    return wide.select(*names).mapInArrow(run, f"{keys}, step int, words array<{kind}>")


def _counts(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _steps(batch: pa.RecordBatch, places: np.ndarray, chars: pa.Array, limit: int | None) -> pa.RecordBatch:
    """The rows of :func:`step_words` for some batches; ids above a ``limit`` are spelled in ``cold``, in their order."""
    seqs = batch.column("rows").flatten()
    sizes = _counts(seqs)
    row = np.repeat(np.repeat(np.arange(batch.num_rows), _counts(batch.column("rows"))), sizes)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ids = pc.fill_null(seqs.flatten().cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
    at = places[np.where((ids >= 0) & (ids < len(places)), ids, 0)]
    at = np.where((ids >= 0) & (ids < len(places)), at, -1)
    if limit is not None:
        late = batch.column("cold").flatten()
        is_late = np.flatnonzero(ids > limit)
        at[is_late] = np.where(pc.is_valid(late).to_numpy(zero_copy_only=False), len(chars) + np.arange(len(late)), -1)
        chars = pa.concat_arrays([chars, late])
    there = np.flatnonzero(at >= 0)
    order = there[np.lexsort((there, pos[there], row[there]))]
    row, pos = row[order], pos[order]
    first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(pos, prepend=-1) != 0))
    words = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), chars.take(pa.array(at[order])))
    own = [batch.column(c).take(pa.array(row[first])) for c in ("seq_len", "batch_no")]
    return pa.RecordBatch.from_arrays([*own, pa.array((pos[first] + 1).astype(np.int32)), words], ["seq_len", "batch_no", "step", "words"])


def _marked(words: Column) -> Column:
    return F.transform(words, lambda w: ar.bracketed(w, tx.SOW_ID, tx.EOW_ID))


def pad_char_steps(steps: DataFrame) -> DataFrame:
    """The words of each time step left-padded to its longest one: ``width``, and ``padded`` and ``mask`` by slot.

    Words are marked; the mask follows the padding, so an unknown character keeps 1 though its id is the padding id.
    """
    width = F.array_max(F.transform("words", lambda w: F.size(w))) + 2
    out = steps.withColumn("width", width).withColumn("_w", _marked(F.col("words")))
    padded = F.transform("_w", lambda w: ar.pad_left(w, F.col("width"), tx.PAD_ID))
    return out.withColumn("padded", padded).withColumn("mask", F.transform("_w", lambda w: ar.mask_left(w, F.col("width")))).drop("_w")


def concat_char_steps(steps: DataFrame, longest: int) -> DataFrame:
    """One character row per time step: its words right-padded to ``longest`` characters one after the other (``ids, mask``)."""
    width = F.lit(longest + 2)
    marked = _marked(F.col("words"))
    return steps.withColumn("ids", F.flatten(F.transform(marked, lambda w: ar.pad_right(w, width, tx.PAD_ID)))).withColumn(
        "mask", F.flatten(F.transform(marked, lambda w: ar.mask_right(w, width)))
    )


def longest_word(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.max(F.length("word")).alias("longest"))


def pad_vocab_right(vocab: DataFrame) -> DataFrame:
    """Vocabulary keys as mark, word, mark and padding up to the longest word: ``id, key``."""
    missing = longest_word(vocab).scalar() - F.length("word")
    return vocab.select(
        "id", F.concat(F.lit(tx.SOW), "word", F.lit(tx.EOW), F.repeat(F.lit(tx.PAD), missing)).alias("key")
    )


def concat_char_batch(batches: DataFrame, vocab: DataFrame) -> DataFrame:
    """One character row per batch of right-padded words: ``batch_no, ids, mask``.

    A batch holds a fixed number of words, so the collected group is bounded.
    """
    width = longest_word(vocab).scalar() + 2
    ids = ar.bracketed(F.col("char_ids"), tx.SOW_ID, tx.EOW_ID)
    padded = batches.select(
        "batch_no", "slot", ar.pad_right(ids, width, tx.PAD_ID).alias("p"), ar.mask_right(ids, width).alias("m")
    )
    return padded.groupBy("batch_no").agg(
        F.flatten(in_order("p", by="slot")).alias("ids"), F.flatten(in_order("m", by="slot")).alias("mask")
    )


def time_major(batches: DataFrame, *columns: str) -> DataFrame:
    """Transpose: ``seq_len, batch_no, step`` and an array for each of the columns (one alone is named ``ids``).

    An array has one entry per slot of the batch. The sequences of a batch meet as they are and are cut in the row.
    """
    columns = columns or ("ids",)
    wide = batches.groupBy("seq_len", "batch_no").agg(F.sort_array(F.collect_list(F.struct("slot", *columns))).alias("rows"))
    last = F.array_max(F.transform("rows", lambda r: F.size(r[columns[0]])))
    names = columns if len(columns) > 1 else ("ids",)

    def cells(column: str, step: Column) -> Column:
        there = F.filter("rows", lambda r: F.size(r[column]) > step)
        return F.transform(there, lambda r: F.get(r[column], step))

    def at(step: Column) -> Column:
        return F.struct(*[cells(c, step).alias(n) for c, n in zip(columns, names, strict=True)])

    steps = F.when(last > 0, F.transform(F.sequence(F.lit(0), last - 1), at))
    cut = wide.select("seq_len", "batch_no", F.posexplode(steps).alias("at", "cells"))
    return cut.select("seq_len", "batch_no", (F.col("at") + 1).alias("step"), *[f"cells.{n}" for n in names])
