"""Tokens to ids and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolex.functions import text as tx
from arbolex.operators.joins import HOT_KEYS, SMALL_ROWS, hot_join, hottest, if_small
from arbolex.operators.numbering import number_rows
from arbolex.operators.vocabulary import tokens
from arbolex.session import materialize

# Vocabulary entries that are sent to every task.
BOUND = 20_000


def in_order(*values: str, by: str = "tok_id") -> Column:
    """Values of one sentence's tokens in order; the group is as long as the sentence."""
    picked = F.sort_array(F.collect_list(F.struct(by, *values)))
    if len(values) == 1:
        return F.transform(picked, lambda s: s[values[0]])
    return F.transform(picked, lambda s: F.struct(*[s[v].alias(v) for v in values]))


def bounded(vocab: DataFrame) -> dict[str, int] | None:
    """The entries of a vocabulary of at most ``BOUND`` words, else nothing."""
    rows = vocab.select("word", "id").limit(BOUND + 1).collect()
    return {r["word"]: r["id"] for r in rows} if len(rows) <= BOUND else None


def frequent(vocab: DataFrame) -> DataFrame:
    """First entries of a frequency-ordered vocabulary: the possible hot words, a bounded number."""
    return vocab.where(F.col("id") <= HOT_KEYS)


def encode_tokens(sents: DataFrame, vocab: DataFrame) -> DataFrame:
    """``sent_id, n, n_unk, ids``; a small ``vocab`` is broadcast."""
    known = if_small(vocab.select("word", "id"))
    ids = tokens(sents.select("sent_id", "words", "n")).join(known, "word", "left")
    return ids.groupBy("sent_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("id").isNull().cast("bigint")).alias("n_unk"),
        F.transform(in_order("id"), lambda i: F.coalesce(i, F.lit(tx.UNK_ID))).alias("ids"),
    )


def _lists(flat: pa.Array, offsets: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(offsets, flat)


def _offsets(lists: pa.ListArray) -> np.ndarray:
    """Bounds of the lists in what ``flatten`` gives."""
    return np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64))


def _part(mask: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bounds of the lists that are left where only marked places are kept."""
    return pa.array(np.append(0, np.cumsum(mask))[bounds].astype(np.int32))


def _known(vocab: DataFrame, limit: int = SMALL_ROWS) -> tuple[pa.Array, np.ndarray, int]:
    """Words and ids of the first entries of a vocabulary, a bounded number, and its largest id."""
    found = vocab.select("word", "id").where(F.col("id") <= limit).toArrow()
    words, ids = (found.column(c).combine_chunks() for c in ("word", "id"))
    return words, ids.to_numpy(zero_copy_only=False), vocab.agg(F.max("id")).first()[0] or 0


def encode_pairs(sents: DataFrame, out_vocab: DataFrame, in_vocab: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """``sent_id, seq_len, out_ids, in_ids``: two id sequences of each sentence, bracketed by the sentence marks.

    The first ``limit`` ids of a vocabulary are looked up inside the row. Only other words are shuffled: to a larger
    vocabulary, and their ids back to the sentence. Sentences without words are left out; ``sent_id`` is unique. The rows
    stay dealt by ``sent_id``, so a join on it does not shuffle them again.
    """
    known = {"out": _known(out_vocab, limit), "in": _known(in_vocab, limit)}
    open_ends = [k for k, (_, _, last) in known.items() if last > limit]
    # numbers that cross the shuffle are no wider than they must be
    wide = {k: np.int32 if last < 1 << 31 else np.int64 for k, (_, _, last) in known.items()}
    names = ["sent_id", "out_ids", "in_ids", *(["cold"] if open_ends else [])]

    def look_up(batches):
        for batch in batches:
            words = batch.column("words")
            bounds, coded = _offsets(words), words.flatten().dictionary_encode()
            at, ids = coded.indices.to_numpy(zero_copy_only=False), {}
            for k, (entries, numbers, _) in known.items():
                place = pc.index_in(coded.dictionary, entries)
                found = numbers[pc.fill_null(place, 0).to_numpy(zero_copy_only=False)] if len(numbers) else np.zeros(len(place), np.int64)
                ids[k] = np.where(pc.is_valid(place).to_numpy(zero_copy_only=False), found, 0)[at]
            cold = np.any([ids[k] == 0 for k in open_ends], axis=0) if open_ends else np.zeros(len(at), bool)
            part = np.append(0, np.cumsum(cold))[bounds]
            # -1, -2 ... is the place of an open word among the cold ones of its sentence
            open_place = np.repeat(part[:-1], np.diff(bounds)) - np.cumsum(cold)
            starts = bounds[:-1] + 2 * np.arange(len(words))
            ends = np.append(starts, bounds[-1] + 2 * len(words))
            inside = np.ones(ends[-1], bool)
            inside[ends[:-1]] = inside[ends[1:] - 1] = False
            columns = [batch.column("sent_id")]
            for k in known:
                marked = np.empty(ends[-1], wide[k])
                marked[inside] = np.where(ids[k] > 0, ids[k], open_place if k in open_ends else tx.UNK_ID)
                marked[ends[:-1]], marked[ends[1:] - 1] = tx.SOS_ID, tx.EOS_ID
                columns.append(_lists(pa.array(marked), pa.array(ends.astype(np.int32))))
            if open_ends:
                columns.append(_lists(words.flatten().filter(pa.array(cold)), pa.array(part.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = sents.schema["sent_id"].dataType.simpleString()
    given = sents.where(F.size("words") > 0).select("sent_id", "words")
    kinds = [f"{k}_ids array<{'int' if wide[k] is np.int32 else 'bigint'}>" for k in known] + ["cold array<string>"] * bool(open_ends)
    rows = given.mapInArrow(look_up, ", ".join([f"sent_id {kind}", *kinds]))
    if open_ends:
        words = rows.select("sent_id", F.posexplode("cold").alias("k", "word"))
        for k, vocab in (("out", out_vocab), ("in", in_vocab)):
            rest = vocab.where(F.col("id") > limit).select("word", F.col("id").alias(f"{k}_cold"))
            words = words.join(rest, "word", "left") if k in open_ends else words
        ids = words.groupBy("sent_id").agg(*[in_order(f"{k}_cold", by="k").alias(f"{k}_cold") for k in open_ends])
        rows = rows.drop("cold").join(ids, "sent_id", "left")

    def filled(k: str) -> Column:
        ids = F.col(f"{k}_ids").cast("array<bigint>")
        if k not in open_ends:
            return ids
        late = lambda i: F.coalesce(F.get(f"{k}_cold", (-1 - i).cast("int")), F.lit(tx.UNK_ID).cast("bigint"))
        return F.transform(ids, lambda i: F.when(i > 0, i).otherwise(late(i)))

    return rows.select("sent_id", F.size("in_ids").alias("seq_len"), *[filled(k).alias(f"{k}_ids") for k in known])


def encode_dual(sents: DataFrame, out_vocab: DataFrame, in_vocab: DataFrame) -> DataFrame:
    """``sent_id, seq_len, seq``: (out_id, in_id) pairs bracketed by the sentence marks, see :func:`encode_pairs`."""
    pairs = F.arrays_zip(F.col("out_ids").alias("out_id"), F.col("in_ids").alias("in_id"))
    return encode_pairs(sents, out_vocab, in_vocab).select("sent_id", "seq_len", pairs.alias("seq"))


def decode_pairs(encoded: DataFrame, out_vocab: DataFrame, in_vocab: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """``sent_id, out_words, in_words`` from ``out_ids, in_ids``, brackets included.

    As in :func:`encode_pairs`, ids up to ``limit`` are named inside the row and only others are shuffled to the
    vocabulary. A pair with an id that a vocabulary does not hold is left out, and so is a sentence of such pairs only.
    """
    known = {"out": _known(out_vocab, limit), "in": _known(in_vocab, limit)}
    open_ends = [k for k, (_, _, last) in known.items() if last > limit]
    places = {}
    for k, (_, numbers, _) in known.items():
        places[k] = np.full(int(numbers.max(initial=0)) + 2, -1, np.int32)  # the last is for ids beyond
        places[k][numbers] = np.arange(len(numbers))
    rows = encoded.select("sent_id", "out_ids", "in_ids")
    for k, vocab in (("out", out_vocab), ("in", in_vocab)):
        if k in open_ends:
            late = encoded.select("sent_id", F.posexplode(F.filter(f"{k}_ids", lambda i: i > limit)).alias("k", "id"))
            named = late.join(vocab.where(F.col("id") > limit).select("id", "word"), "id", "left")
            # an id without a word keeps its place
            rows = rows.join(named.groupBy("sent_id").agg(in_order("word", by="k").alias(f"{k}_cold")), "sent_id", "left")

    def name(batches):
        for batch in batches:
            bounds = _offsets(batch.column("in_ids"))
            words = {}
            for k, (entries, _, _) in known.items():
                ids = batch.column(f"{k}_ids").flatten().to_numpy(zero_copy_only=False)
                at = places[k][np.clip(ids, 0, len(places[k]) - 1)]
                if k in open_ends:
                    at = np.where(ids > limit, len(entries) + np.cumsum(ids > limit) - 1, at)
                    entries = pa.concat_arrays([entries, batch.column(f"{k}_cold").flatten()])
                words[k] = entries.take(pa.array(at, mask=at < 0))
            whole = pc.and_(pc.is_valid(words["out"]), pc.is_valid(words["in"])).to_numpy(zero_copy_only=False)
            columns = [_lists(words[k].filter(pa.array(whole)), _part(whole, bounds)) for k in ("out", "in")]
            yield pa.RecordBatch.from_arrays([batch.column("sent_id"), *columns], ["sent_id", "out_words", "in_words"])

    kind = encoded.schema["sent_id"].dataType.simpleString()
    out = rows.mapInArrow(name, f"sent_id {kind}, out_words array<string>, in_words array<string>")
    return out.where(F.size("in_words") > 0)


def decode_ids(encoded: DataFrame, out_vocab: DataFrame, in_vocab: DataFrame) -> DataFrame:
    """``sent_id, out_words, in_words`` from (out_id, in_id) sequences, brackets included, see :func:`decode_pairs`."""
    pairs = encoded.select("sent_id", F.col("seq.out_id").alias("out_ids"), F.col("seq.in_id").alias("in_ids"))
    return decode_pairs(pairs, out_vocab, in_vocab)


def first_seen_words(tokens_df: DataFrame) -> DataFrame:
    """``word, id, n``: distinct words of a treebank in first-seen order behind the sentence marks."""
    # the place as one number: a smallest struct would be found by sorting all tokens
    place = F.col("sent_id").cast("decimal(19,0)") * F.lit(1 << 31) + F.col("tok_id")
    found = tokens_df.groupBy("word").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    found = materialize(found, "first-seen")  # read for the words and for the marks
    ids = number_rows(found.where(~F.col("word").isin(tx.SOS, tx.EOS)), ["first"], name="id")
    ids = ids.select("word", (F.col("id") + 2).alias("id"), "n")
    marks = found.where(F.col("word").isin(tx.SOS, tx.EOS)).select("word", F.col("n").alias("c"))
    fixed = tokens_df.sparkSession.createDataFrame(
        [(tx.SOS, tx.SOS_ID), (tx.EOS, tx.EOS_ID)], "word string, id long"
    ).join(F.broadcast(marks), "word", "left")
    return ids.unionByName(fixed.select("word", "id", F.coalesce("c", F.lit(0)).alias("n")))


def char_ids(words: DataFrame, chars: DataFrame, unknown: int = tx.PAD_ID, limit: int | None = None) -> DataFrame:
    """Add ``char_ids`` to a table of distinct words (``word, id``).

    ``chars`` is bounded by the alphabet. Computed once per distinct word, never per token.
    """
    word = F.col("word") if limit is None else tx.cut(F.col("word"), limit)
    spelled = words.select("id", "word", F.posexplode(tx.split_chars(word)).alias("at", "ch"))
    found = spelled.join(if_small(chars.withColumnRenamed("id", "ch_id")), "ch", "left")
    return found.groupBy("id", "word").agg(
        F.transform(in_order("ch_id", by="at"), lambda c: F.coalesce(c, F.lit(unknown))).alias("char_ids")
    )


def token_ids(tokens_df: DataFrame, vocab: DataFrame) -> DataFrame:
    """Join every token to its id in a vocabulary with counts (``word, id, n``)."""
    return hot_join(tokens_df, vocab.select("word", "id"), ["word"], hottest(vocab, ["word"]), how="inner")


def id_sequences(tokens_df: DataFrame, vocab: DataFrame) -> DataFrame:
    """``sent_id, n, ids`` over a full first-seen vocabulary."""
    return token_ids(tokens_df, vocab).groupBy("sent_id").agg(
        F.count(F.lit(1)).cast("int").alias("n"), in_order("id").alias("ids")
    )
