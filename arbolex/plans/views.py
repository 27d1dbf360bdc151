"""Input views of the registered queries, all over the whole given tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolex.functions import conllu_blocks as cb
from arbolex.functions import syntax as sy
from arbolex.functions.labels import DEPREL, ROOT, UPOS
from arbolex.operators import vocabulary as vo
from arbolex.session import spread
from arbolex.sources.text import LINE_STRIDE, text_lines

# Longest sentence of the treebank view; longer lines become several sentences.
SENTENCE_WORDS = 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(documents(spark, sf_dir), keep=("lang", "source"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence per line: ``sent_id, doc_id, lang, source, line_no, words, n``."""
    return vo.sentences(lines(spark, sf_dir))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vo.document_word_counts(documents(spark, sf_dir))


def treebank(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """Every line as one or more sentences of at most 26 words, with made-up syntax.

    ``sent_id, doc_id, lang, source, n, forms, upos, heads, deprels``. Built inside the document's
    row, over the arrays of an Arrow batch: no words are left out and nothing is shuffled. ``in_order`` sorts the documents
    first, so sentences stand by id.
    """
    docs = documents(spark, sf_dir)
    if in_order:
        docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text").orderBy("doc_id")

    def run(batches):
        for batch in batches:
            for start, count in sy.slices(batch.column("text")):
                part = batch.slice(start, count)
                rows, number, columns = sy.sentences(part.column("text"), SENTENCE_WORDS)
                own = [part.column(c).take(pa.array(rows)) for c in ("doc_id", "lang", "source")]
                first = pc.multiply_checked(own[0].cast(pa.int64()), LINE_STRIDE)
                ids = pc.add_checked(first, pa.array(number.astype(np.int64) + 1))
                yield pa.RecordBatch.from_arrays([ids, *own, *columns.values()], ["sent_id", "doc_id", "lang", "source", *columns])

    kinds = dict(docs.dtypes)
    own = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "lang", "source"))
    return docs.mapInArrow(run, f"sent_id bigint, {own}, n int, forms array<string>, upos array<int>, heads array<int>, deprels array<int>")


def with_syntax(sents: DataFrame) -> DataFrame:
    """Tags, heads and labels computed from word position and length."""
    root = F.floor((F.col("n") + 1) / 2).cast("int")

    def upos(form: Column, i: Column) -> Column:
        return ((7 * F.length(form) + i + 1) % len(UPOS) + 1).cast("int")

    def head(_: Column, i: Column) -> Column:
        t = i + 1
        before = F.when((root - t) % 3 == 1, root).otherwise(t + 1)
        after = F.when((t - root) % 3 == 1, root).otherwise(t - 1)
        return F.when(t == root, F.lit(0)).when(t < root, before).otherwise(after).cast("int")

    def deprel(form: Column, i: Column) -> Column:
        other = 2 + (5 * (i + 1) + F.length(form)) % (len(DEPREL) - 1)
        return F.when(i + 1 == root, F.lit(ROOT)).otherwise(other).cast("int")

    return sents.select(
        *sents.columns,
        F.transform("forms", upos).alias("upos"),
        F.transform("forms", head).alias("heads"),
        F.transform("forms", deprel).alias("deprels"),
    )


def predicted(sents: DataFrame) -> DataFrame:
    """Predictions that differ from the gold heads in a known way; labels are kept."""
    root = F.floor((F.col("n") + 1) / 2).cast("int")

    def head(_: Column, i: Column) -> Column:
        t = i + 1
        far = (F.col("sent_id") + t) % 5 == 0
        chain = F.when(far, root).when(t < root, t + 1).otherwise(t - 1)
        return F.when(t == root, F.lit(0)).otherwise(chain).cast("int")

    return sents.withColumn("heads", F.transform("forms", head))


def tangled(sents: DataFrame) -> DataFrame:
    """Forests with crossing arcs and several roots: each head lies before its word or is 0."""

    def head(form: Column, i: Column) -> Column:
        return (F.length(form) % (i + 1)).cast("int")

    heads = sents.withColumn("heads", F.transform("forms", head))
    return heads.withColumn(
        "deprels", F.zip_with("heads", "deprels", lambda h, d: F.when(h == 0, F.lit(ROOT)).otherwise(F.greatest(d, F.lit(2))))
    )


def conllu_lines(sents: DataFrame, noisy: bool = False) -> DataFrame:
    """The treebank as CoNLL-U lines: ``sent_id, raws`` in order.

    With a comment, a word range and an empty node that a scan has to skip; every fourth word has a
    label subtype. ``noisy`` spoils tags, heads and labels by word length.
    """
    tags, labels = (F.array(*[F.lit(x) for x in names]) for names in (UPOS, DEPREL))

    def word(w: Column, i: Column) -> Column:
        t, form = i + 1, w["forms"]
        length = F.length(form)
        tag, head, label = F.get(tags, w["upos"] - 1), w["heads"].cast("string"), F.get(labels, w["deprels"] - 1)
        if noisy:
            tag = F.when(length % 11 == 0, F.lit("ZZZ")).otherwise(tag)
            head = F.when(length % 13 == 0, F.lit("_")).otherwise(head)
            label = F.when(length % 17 == 0, F.lit("foo")).when(length % 19 == 0, F.lit("root")).otherwise(label)
        label = F.concat(label, F.when(t % 4 == 0, F.lit(":sub")).otherwise(F.lit("")))
        none = F.lit("_")
        return F.concat_ws("\t", t.cast("string"), form, none, tag, none, none, head, label, none, none)

    # zipped, so that the arrays are computed once per sentence and not once per word in the lambda
    words = F.transform(F.arrays_zip("forms", "upos", "heads", "deprels"), word)
    comment = F.array(F.concat(F.lit("# sent_id = "), F.col("sent_id").cast("string")))
    extra = lambda key: F.lit("\t".join([key, "_", "_", "X", "_", "_", "_", "_", "_", "_"]))
    wide = F.col("n") > 1
    raws = F.concat(
        comment,
        F.when(wide, F.array(extra("1-2"))).otherwise(F.array().cast("array<string>")),
        words,
        F.when(wide, F.array(extra("2.1"))).otherwise(F.array().cast("array<string>")),
    )
    return sents.select("sent_id", raws.alias("raws"))


def conllu_blocks(sents: DataFrame, noisy: bool = False) -> DataFrame:
    """The lines of :func:`conllu_lines` as one text per sentence, made over the arrays of an Arrow batch: ``sent_id, block``."""
    names = ("sent_id", "forms", "upos", "heads", "deprels")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("sent_id"), cb.written(*[batch.column(c) for c in names], noisy)], ["sent_id", "block"])

    return sents.select(*names).mapInArrow(run, "sent_id bigint, block string")


def beam_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beam candidates from the events table: one sentence per user."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sent_id"),
        (F.col("event_id") % 4).cast("int").alias("parent"),
        F.col("event_id").alias("move"),
        (F.col("value") / 10).alias("score"),
        ((F.col("user_id") + F.col("event_id")) % 2).cast("int").alias("parent_cost"),
        (F.col("event_id") % 3).cast("int").alias("move_cost"),
        (F.col("user_id") % 2 == 0).alias("is_final"),
    )


def loss_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss series from the events table: one series per event type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series"), F.col("event_id").alias("ord"), F.col("value").alias("loss")
    )


def training_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One epoch per day of events: ``epoch`` from 0, ``score``."""
    days = (
        table(spark, sf_dir, "events")
        .groupBy(F.to_date("ts").alias("day"))
        .agg(F.avg("value").alias("score"))
    )
    first = days.agg(F.min("day").alias("day")).scalar()
    return days.select(F.date_diff("day", first).alias("epoch"), "score")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))


def label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector per dependency label: the mean of every 37th embedding."""
    rows = vectors(spark, sf_dir).select(
        (F.col("vec_id") % len(DEPREL) + 1).cast("int").alias("deprel"), F.posexplode("vec").alias("i", "x")
    )
    means = rows.groupBy("deprel", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = F.sort_array(F.collect_list(F.struct("i", "x")))
    return means.groupBy("deprel").agg(packed["x"].alias("vec"))
