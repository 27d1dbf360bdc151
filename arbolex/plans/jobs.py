"""The three end-to-end jobs over files: vocabulary, language model, parser."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolex.functions import anchors as an
from arbolex.functions import text as tx
from arbolex.functions import transitions as tr
from arbolex.operators import batching as ba
from arbolex.operators import beam as bm
from arbolex.operators import context_model as cm
from arbolex.operators import encoding as en
from arbolex.operators import features as fe
from arbolex.operators import scores as sc
from arbolex.operators import series as se
from arbolex.operators import training as tn
from arbolex.operators import treebank as tb
from arbolex.operators import vectors as ve
from arbolex.operators import vocabulary as vo
from arbolex.session import materialize
from arbolex.sources import conllu as co
from arbolex.sources import store as st
from arbolex.sources import text as sx


def text_sentences(spark: SparkSession, path) -> DataFrame:
    """Tokenised text, one sentence per line, with sortable ids from file order."""
    lines = sx.read_lines(spark, path)
    blocks = lines.select("pos", F.col("line").alias("block"))
    return vo.sentences(co.number_blocks(blocks).withColumnRenamed("block", "line"))


def vocabulary_job(spark: SparkSession, text: str, out: str, size: int = vo.TOP_N) -> dict[str, DataFrame]:
    """Count words, write the count file and the word list, and save the vocabularies."""
    words = sx.read_lines(spark, text).select(F.explode(tx.split_words(F.col("line"))).alias("word"))
    counts = materialize(vo.word_counts(words), "counts")
    sx.write_counts(counts, f"{out}/counts")
    sx.write_words(counts, f"{out}/words")
    vocab = vo.top_vocab(counts, size)
    st.save_vocabularies(f"{out}/vocab", vocab, vo.char_vocab(sx.read_words(spark, f"{out}/words")))
    return {"counts": counts, "coverage": vo.coverage(counts, size), **st.load_vocabularies(spark, f"{out}/vocab")}


def language_model_job(
    spark: SparkSession, train: str, vocab_path: str, test: str | None = None, upper: int | None = 28
) -> dict[str, DataFrame]:
    """Batch tables of a training text (words and characters of each time step), the context counts over it and the loss
    of every batch in the order it is drawn, with its running average; perplexity of a test text.

    Sentences longer than ``upper - 2`` words are left out of training as the batching does.
    """
    vocab = st.load_vocabularies(spark, vocab_path)["word_vocab"]
    sents = text_sentences(spark, train).where(F.col("n") > 0)
    kept = sents if upper is None else vo.length_filter(sents, upper)
    counts = vo.word_counts(vo.tokens(kept).select("word"))
    every_word = materialize(vo.vocab_ids(vo.ranked_words(counts)), "vocabulary")
    batches = materialize(ba.length_batches(en.encode_dual(kept, vocab, every_word)), "batches")
    ctx = cm.contexts(kept.select("sent_id", "words", "n"), vocab)
    tri = materialize(cm.trigram_counts(ctx), "trigrams")
    scored = materialize(cm.trigram_logprob(tri, tri, vocab.count()), "scored")
    losses = materialize(cm.batch_losses(batches, cm.sentence_logprob(cm.token_logprob(ctx, scored))), "losses")
    running = se.running_loss(losses.select("series", "ord", "loss")).select("ord", "avg_loss")
    spelled = en.char_ids(every_word, st.load_vocabularies(spark, vocab_path)["char_vocab"])
    out = {
        "batches": ba.time_major(batches, "seq"),
        "char_batches": ba.pad_char_steps(ba.step_words(batches, materialize(spelled, "spelled"))),
        "counts": cm.context_counts(tri),
        "losses": losses.join(running, "ord"),
    }
    if test is not None:
        target = text_sentences(spark, test).select("sent_id", "words", "n")
        out["perplexity"] = text_perplexity(target, tri, vocab)
    return out


def text_perplexity(sents: DataFrame, train: DataFrame, vocab: DataFrame) -> DataFrame:
    """Perplexity of sentences (``sent_id, words, n``) under trained trigram counts."""
    target = cm.trigram_counts(cm.contexts(sents, vocab))
    return cm.perplexity(cm.trigram_logprob(target, train, vocab.count()))


def with_vectors(corpus: DataFrame, vectors: DataFrame, neighbours: int = 2) -> DataFrame:
    """Sentences with ``wvec, fvec, bvec`` from word vectors (``word, vec``) of a bounded vocabulary."""
    dim = vectors.select(F.max(F.size("vec"))).first()[0]
    words = vo.tokens(corpus.select("sent_id", "n", F.col("forms").alias("words")))
    nested = ve.context_vectors(ve.sentence_vectors(words, vectors), neighbours, dim)
    return corpus.join(nested, "sent_id")


def parser_job(
    spark: SparkSession,
    files: Sequence[str],
    output: str | None = None,
    save: str | None = None,
    load: str | None = None,
    system: str = tr.DEFAULT_SYSTEM,
    templates: Sequence[str] = an.TEMPLATES,
    beam: int = 1,
    max_iter: int = 20,
    vocab: DataFrame | None = None,
    epochs: int = 0,
    hidden: Sequence[int] = (),
    vectors: DataFrame | None = None,
    trigrams: DataFrame | None = None,
) -> dict:
    """Train on the first treebank, parse and score every one, write the parse of the first.

    With ``load`` a saved model is used instead of training; it must fit ``system`` and ``templates``.
    With ``epochs`` a perceptron of ``hidden`` layers is trained in epochs of ``max_iter`` passes; after each the last
    treebank is parsed greedily, and the model of the best score is used and saved. The curve is returned, and written
    to ``<save>/curve``.
    With ``vectors`` (word vectors of a bounded vocabulary) the dense templates take part.
    With ``vocab`` (a bounded output vocabulary) the unknown-word rate over all files is reported, and with
    ``trigrams`` (context counts over that vocabulary) also the perplexity of every file.
    """
    corpora = [materialize(co.read_conllu(spark, f), "treebank") for f in files]
    if vectors is not None:
        corpora = [materialize(with_vectors(c, vectors), "treebank") for c in corpora]
    known = [c for c in fe.VECTORS if vectors is not None]

    def parsed(corpus: DataFrame, model: PipelineModel, beam: int) -> DataFrame:
        plain, scores = corpus.select("sent_id", "n", "upos", *known), tn.row_scorer(model, templates)
        return bm.parse_rows(plain, scores, system) if beam == 1 else bm.parse_beam(plain, scores, system, beam)

    def las(corpus: DataFrame, model: PipelineModel) -> float:
        return sc.las(sc.arc_matches(corpus, parsed(corpus, model, 1))).first()["las"] or 0.0

    out: dict = {"las": [], "quality": [tb.quality(c).first().asDict() for c in corpora]}
    if load is not None:
        model, _ = st.load_model(spark, load, system, templates)
    else:
        rows = materialize(tn.training_rows(tb.sound(corpora[0]), system, templates), "training")
        if epochs:
            model, out["curve"] = tn.train_epochs(rows, lambda m: las(corpora[-1], m), epochs, system, templates, hidden, max_iter)
        else:
            model = tn.train_moves(rows, system, templates, max_iter=max_iter)
    if save is not None:
        st.save_model(save, model, system, templates)
        if "curve" in out:
            out["curve"].write.mode("overwrite").parquet(f"{save}/curve")
    for i, corpus in enumerate(corpora):
        parses = parsed(corpus, model, beam)
        out["las"].append(sc.las(sc.arc_matches(corpus, parses)).first()["las"])
        if i == 0 and output is not None:
            # a sentence id is the number of its block, so blocks and predictions meet on it
            guesses = parses.join(corpus.select("sent_id", "forms"), "sent_id")
            rewritten = co.rewrite_blocks(co.placed_blocks(spark, files[0]), guesses)
            co.write_blocks(rewritten.withColumnRenamed("block", "value"), output)
    if vocab is not None:
        words = tb.union_corpora(**{f"f{i}": c.select(F.explode("forms").alias("word")) for i, c in enumerate(corpora)})
        out["unknown"] = vo.unknown_rate(vo.word_counts(words.select("word")), vocab).first().asDict()
        if trigrams is not None:
            texts = [c.select("sent_id", F.col("forms").alias("words"), "n") for c in corpora]
            out["perplexity"] = [text_perplexity(t, trigrams, vocab).first()["perplexity"] for t in texts]
    return out
