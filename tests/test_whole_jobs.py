"""Registered queries over rows of their own: that they do the whole of what they name."""

import numpy as np
import pytest

from arbolex.functions import transitions as tr
from arbolex.operators import batching as ba
from arbolex.operators import beam as bm
from arbolex.operators import features as fe
from arbolex.operators import logistic as lo
from arbolex.operators import training as tn
from arbolex.plans.queries import BEAM, QUERIES


@pytest.fixture
def folder(spark, tmp_path):
    """A documents table of varied words; returns the folder."""
    def line(i):
        return " ".join("abcdefghijkl"[: 1 + (i * i + 5 * j + i * j) % 9] + "xyz"[: (i + j) % 3] for j in range(3 + i % 8))

    rows = [(i, ("en", "de")[i // 2 % 2], "web", "\n".join(line(3 * i + k) for k in range(4))) for i in range(24)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_parse_corpus_searches_with_a_beam(spark, folder, monkeypatch):
    made, parse = [], bm.parse_blocks

    def seen(sents, scores, **given):
        made.append((sents, scores, parse(sents, scores, **given)))
        return made[-1][2]

    monkeypatch.setattr(bm, "parse_blocks", seen)
    rows = QUERIES["parse_corpus"](spark, folder).collect()
    assert sum(r.n_words for r in rows) == sum(s.selectExpr("sum(n)").first()[0] for s, _, _ in made)
    better = 0
    for sents, scores, out in made:
        found = {r.sent_id: r.score for r in out.collect()}
        assert found == {r.sent_id: r.score for r in parse(sents, scores, beam=BEAM).collect()}
        better += sum(found[r.sent_id] > r.score + 1e-6 for r in parse(sents, scores, beam=1).collect())
    assert better > 0


def test_a_fit_starts_from_the_counts(spark, sentences, monkeypatch):
    """The gradient where no input has a weight is that of a look at all rows."""
    rows = tn.training_blocks(sentences([2, 0, 2], [0, 1], [3, 3, 0, 3], [2, 0, 2, 3, 3])).cache()
    looks, added = [], lo._added
    monkeypatch.setattr(lo, "_added", lambda *given: looks.append(1) or added(*given))
    starts, minimum = [], lo.minimum
    monkeypatch.setattr(lo, "minimum", lambda look, at, *given: starts.append((look(at), look(at + 1e-12))) or minimum(look, at, *given))
    lo.fit(rows, fe.feature_count(), tr.move_count(tr.DEFAULT_SYSTEM), 0)
    (value, slope), (near, near_slope) = starts[0]
    assert len(looks) == 2  # the counts, and the start a little further on
    assert value == pytest.approx(near, rel=1e-5)
    assert np.abs(slope - near_slope).max() < 1e-5


@pytest.mark.parametrize("limit", [0, 5, 6, 1000])
def test_words_of_a_step_are_the_same_however_many_are_spelled_in_place(spark, limit):
    seq = lambda *ids: [(0, i) for i in ids]
    batches = spark.createDataFrame(
        [(5, 0, 1, seq(1, 8, 7, 5, 2)), (5, 0, 0, seq(1, 5, 6, 9, 2)), (3, 3, 0, seq(1, 9, 2)), (3, 4, 0, seq(1, 6, 2))],
        "seq_len int, batch_no long, slot int, seq array<struct<out_id:int,in_id:long>>",
    )
    # 9 is not spelled and left out
    spelled = spark.createDataFrame([(1, [9]), (2, [9, 9]), (5, [4]), (6, [5, 6, 7]), (7, [1, 8]), (8, [])], "id long, char_ids array<int>")
    steps = ba.step_words(batches, spelled.repartition(3), limit)
    assert dict(steps.dtypes) == {"seq_len": "int", "batch_no": "bigint", "step": "int", "words": "array<array<int>>"}
    assert {(r.seq_len, r.batch_no, r.step): r.words for r in steps.collect()} == {
        (5, 0, 1): [[9], [9]], (5, 0, 2): [[4], []], (5, 0, 3): [[5, 6, 7], [1, 8]], (5, 0, 4): [[4]], (5, 0, 5): [[9, 9], [9, 9]],
        (3, 3, 1): [[9]], (3, 3, 3): [[9, 9]], (3, 4, 1): [[9]], (3, 4, 2): [[5, 6, 7]], (3, 4, 3): [[9, 9]],
    }
