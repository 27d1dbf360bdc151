"""What is looked up or added up inside the sentence's row, next to the forms that join and group."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbolex.functions import text as tx
from arbolex.operators import context_model as cm
from arbolex.operators import encoding as en
from arbolex.operators import treebank as tb
from arbolex.operators import vectors as ve
from arbolex.operators import vocabulary as vo
from arbolex.sources import conllu as co


@pytest.fixture
def texts(spark):
    rng = random.Random(5)
    lines = ["", " a ", f"{tx.SOS} b {tx.EOS}", *[" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))) for _ in range(40)]]
    return vo.sentences(spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(lines)], "sent_id long, fold int, line string"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contexts_and_known_words_are_looked_up_in_the_row(spark, texts, monkeypatch):
    """Each side of a token was joined, and the known words were shuffled back to their sentences."""
    vocab = vo.top_vocab(vo.word_counts(vo.tokens(texts).select("word")), 4)
    found, known = cm.contexts(texts, vocab), ve.map_to_known(texts, vocab)
    for df in (found, known):
        assert "Join" not in plan_of(df) and "Aggregate" not in plan_of(df)
    for module in (cm, ve):
        monkeypatch.setattr(module, "bounded", lambda vocab: None)
    want = cm.contexts(texts, vocab)
    assert found.schema.simpleString() == want.schema.simpleString()
    assert sorted(found.collect()) == sorted(want.collect())
    assert sorted(known.collect()) == sorted(ve.map_to_known(texts, vocab).collect())


def test_a_large_vocabulary_is_not_collected(spark, monkeypatch):
    vocab = spark.createDataFrame([("a", 4), ("b", 5)], "word string, id long")
    assert en.bounded(vocab) == {"a": 4, "b": 5}
    monkeypatch.setattr(en, "BOUND", 1)
    assert en.bounded(vocab) is None


def test_vector_summaries_equal_the_sums(spark, sentences):
    """Arcs were shuffled by head, and vectors added by an interpreted expression."""
    trees = [[2, 0, 2], [0], [3, 3, 0, 3, 3, 4], [0, 1, 1, 1], [5, 5, 5, 5, 0], [0, 0]]
    sents = sentences(*trees)
    vectors = spark.createDataFrame([(i, [i / 7, -i / 3, i * 0.1]) for i in range(1, 38)], "deprel int, vec array<double>")
    marks = {"first": lambda v: v[:, 0], "last": lambda v: v[:, -1]}
    got = tb.vector_summaries(sents, vectors, marks)
    assert "Exchange" not in plan_of(got)
    want = tb.vector_sums(co.token_rows(sents).select("sent_id", "tok_id", "head", "deprel"), vectors)
    want = want.select("sent_id", "head", *[F.get(f"{s}_sum", F.lit(i)) for s in ("left", "right") for i in (0, 2)])
    assert np.allclose(sorted(map(tuple, got.collect())), sorted(map(tuple, want.collect())), rtol=1e-12, atol=0)
    with pytest.raises(Exception, match="own head"):
        tb.vector_summaries(sentences([1, 0]), vectors, marks).collect()


def test_first_seen_words_are_read_once_and_not_sorted(spark):
    rows = [(2, 1, "b"), (1, 2, "a"), (1, 1, tx.EOS), (1, 3, "b"), (3, 1, "c"), (1 << 60, 9, "z"), (3, 2, "a")]
    tokens = spark.createDataFrame(rows, "sent_id long, tok_id int, word string")
    found = en.first_seen_words(tokens)
    assert "SortAggregate" not in plan_of(found) and "Scan ExistingRDD" in plan_of(tokens)
    got = {r.word: (r.id, r.n) for r in found.collect()}
    assert got == {tx.SOS: (1, 0), tx.EOS: (2, 1), "a": (3, 2), "b": (4, 2), "c": (5, 1), "z": (6, 1)}


def test_word_counts_of_whole_texts(spark):
    """A row for every word went to the aggregate."""
    docs = spark.createDataFrame([(" a b\na\x0bç ",), (None,), ("",), ("a",)], "text string")
    counts = vo.document_word_counts(docs)
    assert {r.word: r.n for r in counts.collect()} == {"a": 3, "b": 1, "ç": 1}
    assert counts.dtypes == [("word", "string"), ("n", "bigint")] and "Generate" not in plan_of(counts)
    assert np.isclose(counts.agg(F.sum("n")).first()[0], 5)
