"""Two-sided count model: context counts, word log-probabilities and perplexity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolex.functions import text as tx
from arbolex.operators.batching import scheduled_batches
from arbolex.operators.encoding import bounded
from arbolex.operators.joins import hot_join, hottest, if_small
from arbolex.session import materialize

# Weights of the two-sided, left, right and unigram terms, and the smoothing constant.
W_BOTH, W_LEFT, W_RIGHT, W_WORD, ALPHA = 0.5, 0.15, 0.15, 0.2, 0.1
# Sentences that are looked up at once.
SENTENCES = 2_000


def contexts(sents: DataFrame, vocab: DataFrame) -> DataFrame:
    """Each token as ids with both neighbours: ``sent_id, tok_id, l, w, r`` plus sentence columns.

    ``vocab`` is a top-N vocabulary; any other word becomes the unknown word. Sentences are looked up and cut into tokens
    where they are, so no token is shuffled to meet its neighbours.
    """
    known = bounded(vocab)
    if known is None:
        return _joined_contexts(sents, vocab)
    keep = [c for c in sents.columns if c not in ("words", "n")]
    kinds, kind = dict(sents.dtypes), dict(vocab.dtypes)["id"]
    marks = [known.get(mark, tx.UNK_ID) for mark in (tx.SOS, tx.EOS)]
    sent = sents.sparkSession.sparkContext.broadcast((pa.array(list(known), pa.string()), np.array([*known.values(), tx.UNK_ID], np.int64)))
    number = pa.int64() if kind == "bigint" else pa.int32()

    def run(batches):
        words, ids = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, SENTENCES):
                part = batch.slice(start, SENTENCES)
                sizes = pc.fill_null(pc.list_value_length(part.column("words")), 0).to_numpy(zero_copy_only=False)
                found = pc.index_in(part.column("words").flatten(), words)
                now = ids[pc.fill_null(found, len(ids) - 1).to_numpy(zero_copy_only=False)]
                ends = np.cumsum(sizes)
                place = np.arange(len(now)) - np.repeat(ends - sizes, sizes)
                before, after = np.roll(now, 1), np.roll(now, -1)
                before[place == 0], after[ends[sizes > 0] - 1] = marks
                rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                near = [pa.array(x).cast(number) for x in (before, now, after)]
                columns = [*[part.column(c).take(rows) for c in keep], pa.array((place + 1).astype(np.int32)), *near]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "tok_id", "l", "w", "r"])

    own = "".join(f"`{c}` {kinds[c]}, " for c in keep)
    return sents.select(*keep, "words").mapInArrow(run, f"{own}tok_id int, l {kind}, w {kind}, r {kind}")


def _joined_contexts(sents: DataFrame, vocab: DataFrame) -> DataFrame:
    """As :func:`contexts`, for a vocabulary of any size."""
    keep = [c for c in sents.columns if c not in ("words", "n")]
    beside = lambda at, mark: F.coalesce(F.get("words", at), F.lit(mark))
    near = F.transform(
        "words",
        lambda w, i: F.struct(beside(i - 1, tx.SOS).alias("l"), w.alias("w"), beside(i + 1, tx.EOS).alias("r")),
    )
    rows = sents.select(*keep, F.posexplode_outer(near).alias("pos", "near")).where(F.col("pos").isNotNull())
    rows = rows.select(*keep, (F.col("pos") + 1).alias("tok_id"), "near.l", "near.w", "near.r")
    known = if_small(vocab.select(F.col("word").alias("_word"), F.col("id").alias("_id")))
    for side in ("l", "w", "r"):
        rows = rows.join(known, F.col(side) == F.col("_word"), "left")
        rows = rows.withColumn(side, F.coalesce("_id", F.lit(tx.UNK_ID))).drop("_word", "_id")
    return rows


def trigram_counts(ctx: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``l, w, r, n`` per ``by``; everything else of the model follows from this table."""
    return ctx.groupBy(*by, "l", "w", "r").agg(F.count(F.lit(1)).alias("n"))


def context_counts(tri: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All back-off levels in one table: ``kind, l, w, r, n`` (0 for a position left out)."""
    levels = {"lwr": "lwr", "l_r": "lr", "lw_": "lw", "_wr": "wr", "l__": "l", "__r": "r", "_w_": "w"}
    out = None
    for kind, kept in levels.items():
        level = tri.groupBy(*by, *kept).agg(F.sum("n").alias("n")) if kind != "lwr" else tri
        level = level.select(
            *by,
            F.lit(kind).alias("kind"),
            *[(F.col(c) if c in kept else F.lit(0)).cast("int").alias(c) for c in "lwr"],
            "n",
        )
        out = level if out is None else out.unionByName(level)
    return out


def trigram_logprob(target: DataFrame, train: DataFrame, vocab_size: int, by: Sequence[str] = ()) -> DataFrame:
    """Add ``logp`` to the distinct (l, w, r) rows of ``target`` from the counts in ``train``.

    Single-word tables have at most ``vocab_size`` rows per ``by`` group and are broadcast; the
    pair tables are joined by shuffle, where one pair matches at most ``vocab_size`` rows.
    """
    by = list(by)

    def level(kept: str, name: str) -> DataFrame:
        return train.groupBy(*by, *kept).agg(F.sum("n").alias(name))

    out = target.join(train.withColumnRenamed("n", "c_lwr"), [*by, "l", "w", "r"], "left")
    for kept in ("lr", "lw", "wr"):
        out = out.join(level(kept, f"c_{kept}"), [*by, *kept], "left")
    for kept in ("l", "r", "w"):
        out = out.join(if_small(level(kept, f"c_{kept}")), [*by, kept], "left")
    total = train.groupBy(*by).agg(F.sum("n").alias("c_all"))
    if by:
        out = out.join(F.broadcast(total), by, "left")
    else:
        out = out.withColumn("c_all", total.select("c_all").scalar())

    def share(part: str, whole: str):
        ratio = F.col(part) / F.col(whole)
        return F.coalesce(ratio, F.lit(0.0))

    unigram = (F.coalesce("c_w", F.lit(0)) + ALPHA) / (F.coalesce("c_all", F.lit(0)) + vocab_size * ALPHA)
    p = (
        W_BOTH * share("c_lwr", "c_lr")
        + W_LEFT * share("c_lw", "c_l")
        + W_RIGHT * share("c_wr", "c_r")
        + W_WORD * unigram
    )
    return out.select(*target.columns, F.log(p).alias("logp"))


def other_fold(tri: DataFrame) -> DataFrame:
    """Counts that score a fold: those of the other one."""
    return tri.withColumn("fold", 1 - F.col("fold"))


def token_logprob(ctx: DataFrame, scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Attach ``logp`` to every token (or counted group of tokens). ``scored`` has the distinct (l, w, r) rows with ``n, logp``.

    A single trigram (three unknown words) can be a large part of a corpus, hence the hot join.
    """
    keys = [*by, "l", "w", "r"]
    return hot_join(ctx, scored.select(*keys, "logp"), keys, hottest(scored, keys), how="inner")


def perplexity(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``exp(-mean logp)`` over tokens, from distinct rows weighted by ``n``."""
    return scored.groupBy(*by).agg(
        F.sum("n").alias("n_tokens"), F.exp(-F.sum(F.col("logp") * F.col("n")) / F.sum("n")).alias("perplexity")
    )


def sentence_logprob(tokens_scored: DataFrame) -> DataFrame:
    return tokens_scored.groupBy("sent_id").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.sum("logp").alias("sum_logp")
    )


def batch_losses(batches: DataFrame, scored: DataFrame, series: str = "train") -> DataFrame:
    """Loss of every batch in the order of the schedule: ``series, ord, loss, seq_len, batch_no``.

    ``batches`` has the sentences of full length batches, ``scored`` their ``sum_logp`` and ``n``, see
    :func:`sentence_logprob`. The loss is minus the mean log-probability of the batch's words; the rows are what
    ``series.running_loss`` reads.
    """
    order = scheduled_batches(batches).drop("n_sent")
    sums = batches.select("seq_len", "batch_no", "sent_id").join(scored.select("sent_id", "n", "sum_logp"), "sent_id")
    means = sums.groupBy("seq_len", "batch_no").agg((-F.sum("sum_logp") / F.sum("n")).alias("loss"))
    return means.join(order, ["seq_len", "batch_no"]).select(
        F.lit(series).alias("series"), F.col("position").alias("ord"), "loss", "seq_len", "batch_no"
    )


def perplexity_macro(batches: DataFrame) -> DataFrame:
    """Exp of the mean of batch means; rows are sentences with ``seq_len, batch_no, n, sum_logp``."""
    means = batches.groupBy("seq_len", "batch_no").agg((F.sum("sum_logp") / F.sum("n")).alias("m"))
    return means.agg(F.count(F.lit(1)).alias("n_batches"), F.exp(-F.avg("m")).alias("perplexity"))


def cross_fitted(
    sents: DataFrame, vocab: DataFrame, extra: Sequence[str] = (), keep_tokens: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Tokens in context and distinct scored rows when each fold is scored by the other's counts.

    With ``keep_tokens`` the tokens are written as ids: they are counted and then joined with their scores, and not
    tokenised and looked up anew for each.
    """
    ctx = contexts(sents.select("sent_id", "words", "n", "fold", *extra), vocab)
    if keep_tokens:
        ctx = materialize(ctx, "contexts")
    tri = materialize(trigram_counts(ctx, ["fold"]), "trigrams")
    return ctx, trigram_logprob(tri, other_fold(tri), vocab.count(), ["fold"])
