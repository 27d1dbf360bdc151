"""Word counts, top-N vocabularies, ids, coverage and character vocabularies."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbolex.functions import syntax as sy
from arbolex.functions import text as tx
from arbolex.operators.numbering import number_rows, number_small
from arbolex.session import materialize

TOP_N = 1000


def sentences(lines: DataFrame) -> DataFrame:
    """Tokenise lines: adds ``words`` and ``n``."""
    return lines.withColumn("words", tx.split_words(F.col("line"))).withColumn("n", F.size("words")).drop("line")


def tokens(sents: DataFrame) -> DataFrame:
    """One row per token: ``sent_id, tok_id, word`` plus the other columns of the sentence."""
    keep = [c for c in sents.columns if c not in ("words", "n")]
    # the outer form keeps the optimizer from tokenising once more to test for empty arrays
    rows = sents.select(*keep, F.posexplode_outer("words").alias("pos", "word"))
    return rows.where(F.col("pos").isNotNull()).select(*keep, (F.col("pos") + 1).alias("tok_id"), "word")


def word_counts(words: DataFrame) -> DataFrame:
    """``word, n``; the partial aggregate keeps hot words from crossing the shuffle."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def document_word_counts(documents: DataFrame) -> DataFrame:
    """Word counts straight from whole texts (a line break is white space too).

    The words of a few MB of text are counted where they are, so a task hands on each of them once and not every time.
    """

    def run(batches):
        for batch in batches:
            for start, count in sy.slices(batch.column("text")):
                found = sy.cut(batch.column("text").slice(start, count))[-1].value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

    return documents.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def sorted_counts(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.col("n").desc(), "word")


def top_n(counts: DataFrame, size: int = TOP_N) -> DataFrame:
    """``word, n, rank`` of the ``size`` most frequent words, ties by word.

    Each task keeps its own best ``size`` rows, and only those meet; the rank is a number over ``size`` rows at most.
    """
    order = [F.col("n").desc(), F.col("word")]
    best = counts.orderBy(*order).limit(size)
    return number_small(best, order, "rank").withColumn("rank", F.col("rank").cast("bigint"))


def _merged(words: DataFrame, value: str, added: Column, unique: bool) -> DataFrame:
    """``word`` and ``value``, which is ``added`` over the words that share their first 65 characters.

    Of ``unique`` words only those of 65 characters and more can share them, so the others are not shuffled.
    """
    cut = tx.cut(F.col("word"), tx.VOCAB_WORD_LIMIT).alias("word")
    if not unique:
        return words.groupBy(cut).agg(added.alias(value))
    short = F.length("word") < tx.VOCAB_WORD_LIMIT
    return words.where(short).select("word", value).unionByName(words.where(~short).groupBy(cut).agg(added.alias(value)))


def top_vocab(counts: DataFrame, size: int = TOP_N, unique: bool = False) -> DataFrame:
    """``word, id`` of the top-N vocabulary behind the three reserved words.

    Words are cut at 65 characters before they are ranked, so words that share their cut form are one entry. ``unique``
    says that ``counts`` has no word twice.
    """
    merged = _merged(counts, "n", F.sum("n"), unique)
    words = top_n(merged.where(~F.col("word").isin(tx.SOS, tx.EOS, tx.UNK)), size)
    ids = words.select("word", (F.col("rank") + tx.N_RESERVED).alias("id"))
    # written, since look-ups read it more than once and must not count the words again
    return materialize(ids.unionByName(reserved_words(counts.sparkSession)), "top-words")


def reserved_words(spark) -> DataFrame:
    rows = [(tx.SOS, tx.SOS_ID), (tx.EOS, tx.EOS_ID), (tx.UNK, tx.UNK_ID)]
    return spark.createDataFrame(rows, "word string, id long")


def vocab_ids(words: DataFrame, order: str = "pos", unique: bool = False) -> DataFrame:
    """``word, id`` in first-seen order behind the reserved words.

    Words are cut at 65 characters first, so twins that share them get one id; a later
    duplicate never changes an id. ``unique`` says that there is no word twice.
    """
    seen = words.select("word", F.col(order).alias("_seen"))
    firsts = _merged(seen, "_seen", F.min("_seen"), unique).where(~F.col("word").isin(tx.SOS, tx.EOS, tx.UNK))
    ids = number_rows(firsts, ["_seen", "word"], name="id")
    return ids.select("word", (F.col("id") + tx.N_RESERVED).alias("id")).unionByName(
        reserved_words(words.sparkSession)
    )


def ranked_words(counts: DataFrame) -> DataFrame:
    """Words with the position they have in a count-sorted word list: ``pos, word``."""
    return counts.select(F.struct((-F.col("n")).alias("neg_n"), F.col("word").alias("w")).alias("pos"), "word")


def coverage(counts: DataFrame, *sizes: int) -> DataFrame:
    """Share of the token mass held by the most frequent words, in percent, for each vocabulary size."""
    total = counts.agg(F.sum("n").alias("total"))
    ranked = top_n(counts, max(sizes)).select("n", "rank", F.explode(F.lit(list(sizes))).alias("vocab_size"))
    covered = ranked.where(F.col("rank") <= F.col("vocab_size")).groupBy("vocab_size").agg(F.sum("n").alias("covered"))
    return covered.withColumn("total", total.scalar()).withColumn(
        "coverage", F.col("covered") / F.col("total") * 100
    )


def coverage_curve(counts: DataFrame) -> DataFrame:
    """Coverage at every vocabulary size: ``rank, word, n, covered, coverage``."""
    total = counts.agg(F.sum("n").alias("total"))
    ranked = number_rows(counts, [F.col("n").desc(), "word"], name="rank", running={"covered": "n"})
    return ranked.select(
        "rank", "word", "n", "covered", (F.col("covered") / total.scalar() * 100).alias("coverage")
    )


def vocab_quality(lines: DataFrame) -> DataFrame:
    """What a word-list reader would report about ``line``: blank, multi-token, too long, kept."""
    parts = tx.split_words(F.col("line"))
    first = F.get(parts, F.lit(0))
    count = lambda cond: F.coalesce(F.sum(cond.cast("bigint")), F.lit(0))
    return lines.agg(
        F.count(F.lit(1)).alias("n_lines"),
        count(F.size(parts) == 0).alias("n_blank"),
        count(F.size(parts) > 1).alias("n_multi"),
        count(F.coalesce(F.length(first), F.lit(0)) > tx.VOCAB_WORD_LIMIT).alias("n_long"),
        count(F.size(parts) > 0).alias("n_kept"),
    )


def truncated_words(words: DataFrame) -> DataFrame:
    """Vocabulary form (65 characters) and character-encoding form (32) of each distinct word."""
    return words.select("word").distinct().select(
        "word",
        tx.cut(F.col("word"), tx.VOCAB_WORD_LIMIT).alias("vocab_word"),
        tx.cut(F.col("word"), tx.CHAR_WORD_LIMIT).alias("char_word"),
    )


def reserved_char_report(counts: DataFrame) -> DataFrame:
    """Words and tokens that hold a reserved character."""
    hit = tx.has_reserved_char(F.col("word"))
    return counts.agg(
        F.count(F.lit(1)).alias("n_words"),
        F.sum(hit.cast("bigint")).alias("n_reserved_words"),
        F.sum(F.when(hit, F.col("n")).otherwise(0)).cast("bigint").alias("n_reserved_tokens"),
    )


def char_vocab(words: DataFrame, limit: int | None = None) -> DataFrame:
    """``ch, id``: characters in first-seen order over a word list, or over its first ``limit`` lines.

    ``words`` has ``pos, word``. The space is skipped; ids follow the three reserved characters.
    """
    head = words if limit is None else words.orderBy("pos").limit(limit)
    seen = (
        head.select(F.col("pos").alias("line"), F.posexplode(tx.split_chars(F.col("word"))).alias("at", "ch"))
        .where(~F.col("ch").isin(" ", "", tx.PAD, tx.SOW, tx.EOW))
        .groupBy("ch")
        .agg(F.min(F.struct("line", "at")).alias("first"))
    )
    ids = number_small(seen, ["first"], "id").select("ch", (F.col("id") + tx.N_RESERVED).cast("int").alias("id"))
    reserved = [(tx.PAD, tx.PAD_ID), (tx.SOW, tx.SOW_ID), (tx.EOW, tx.EOW_ID)]
    return ids.unionByName(words.sparkSession.createDataFrame(reserved, "ch string, id int"))


def max_lengths(sents: DataFrame) -> DataFrame:
    """Longest word in characters and longest sentence in words."""
    longest = F.array_max(F.transform("words", lambda w: F.length(w)))
    return sents.agg(
        F.max(longest).alias("max_word_chars"),
        F.least(F.max(longest), F.lit(tx.CHAR_WORD_LIMIT)).alias("max_encoded_chars"),
        F.max("n").alias("max_sentence_words"),
    )


def unknown_rate(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Unknown and total tokens from word counts; both sides have a row per word, so no key is hot."""
    marked = counts.join(vocab.select("word", F.lit(True).alias("known")), "word", "left")
    unknown = F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0))
    return marked.agg(
        unknown.cast("bigint").alias("unknown"),
        F.sum("n").alias("total"),
        (unknown / F.sum("n")).alias("unk_rate"),
    )


def oov_words(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Counted words outside a vocabulary."""
    return counts.join(vocab.select("word"), "word", "left_anti")


def length_filter(sents: DataFrame, upper: int = 28, min_words: int | None = None) -> DataFrame:
    """Keep sentences whose bracketed length fits ``upper``; a lower bound only when asked for."""
    kept = sents.where(F.col("n") <= upper - 2)
    return kept if min_words is None else kept.where(F.col("n") >= min_words)


def training_filter(sents: DataFrame, shortest: int = 2, longest: int = 64) -> DataFrame:
    """Keep training lengths; fails when nothing is left."""
    kept = sents.where(F.col("n").between(shortest, longest))
    if kept.isEmpty():
        raise ValueError(f"no sentences of {shortest} to {longest} words")
    return kept


def corpus_stats(sents: DataFrame, shortest: int = 2, longest: int = 64) -> DataFrame:
    """Sentences and words before and after the training filter."""
    kept = F.col("n").between(shortest, longest)
    return sents.agg(
        F.count(F.lit(1)).alias("n_sent_all"),
        F.sum("n").cast("bigint").alias("n_word_all"),
        F.sum(kept.cast("bigint")).alias("n_sent"),
        F.sum(F.when(kept, F.col("n")).otherwise(0)).cast("bigint").alias("n_word"),
    )


def context_windows(sents: DataFrame) -> DataFrame:
    """Each word with both neighbours and the size of its two-sided context.

    Everything comes from the sentence's array: the words joined by a space give the characters up to a word in one
    pass, so no token is shuffled.
    """
    # running number of characters before each word
    step = lambda done, w: F.concat(done, F.array(F.element_at(done, -1) + F.length(w)))
    before = F.aggregate("words", F.array(F.lit(0)), step)
    rows = sents.select("sent_id", "words", "n", before.alias("before")).select(
        "sent_id",
        "n",
        F.element_at("before", -1).alias("total"),
        F.posexplode(
            F.transform(
                "words",
                lambda w, i: F.struct(
                    w.alias("word"),
                    F.coalesce(F.get("words", i - 1), F.lit(tx.SOS)).alias("left_word"),
                    F.coalesce(F.get("words", i + 1), F.lit(tx.EOS)).alias("right_word"),
                    F.get("before", i).alias("left_chars"),
                ),
            )
        ).alias("pos", "w"),
    )
    return rows.select(
        "sent_id",
        (F.col("pos") + 1).alias("tok_id"),
        "w.word",
        "w.left_word",
        "w.right_word",
        F.col("pos").alias("n_left"),
        (F.col("n") - F.col("pos") - 1).cast("bigint").alias("n_right"),
        F.col("w.left_chars").cast("bigint").alias("left_chars"),
        (F.col("total") - F.col("w.left_chars") - F.length("w.word")).cast("bigint").alias("right_chars"),
    )
