import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbolex.functions import anchors as an
from arbolex.functions import transitions as tr
from arbolex.operators import beam as bm
from arbolex.operators import candidates as ca
from arbolex.operators import features as fe
from arbolex.operators import gold
from arbolex.operators import logistic as lo
from arbolex.operators import scores as sc
from arbolex.operators import training as tn
from arbolex.sources import store as st


@pytest.mark.parametrize("bad", ["x0p", "s0", "s0q", "n1lL", "n0rL", "s0l0L", "s0w"])
def test_bad_templates_fail(bad):
    with pytest.raises(ValueError):
        an.parse_template(bad)


def state_row(spark):
    """Words 1..7; stack 3 5; 1, 2 and 4 hang on 3 and 5; buffer from 6."""
    row = [(1, 7, [1, 2, 3, 4, 5, 6, 7], ([3, 5], 6, [3, 3, 0, 5, 0, 0, 0], [9, 8, 1, 7, 1, 1, 1]))]
    return spark.createDataFrame(row, "sent_id long, n int, upos array<int>, state " + tr.STATE)


def test_anchors(spark):
    names = ["s0", "s1", "s2", "n0", "n1", "n2", "s0l", "s1l", "s1l2", "s1l3", "s1r", "s0lh", "s0lhl", "n0l"]
    out = fe.feature_anchors(state_row(spark), [f"{x}p" for x in names]).first()
    got = [out[x] for x in names]
    assert got == [5, 3, 0, 6, 7, 0, 4, 1, 2, 0, 0, 5, 4, 0]


def test_feature_ids(spark):
    templates = ["s1p", "s1A", "s1a", "s1b", "s0d", "s1d", "s1lL", "n0a", "n2p"]
    off = fe.feature_offsets(templates)
    out = sorted(fe.transition_features(state_row(spark), templates).first().feature_ids)
    want = [
        off["s1p"] + 2, off["s1A"] + 8, off["s1A"] + 7, off["s1a"] + 2, off["s1b"] + 0,
        off["s0d"] + 0, off["s1d"] + 1, off["s1lL"] + 8, off["n0a"] + 0,
    ]
    assert out == sorted(want)
    assert fe.feature_count(templates) == 17 + 37 + 10 + 10 + 10 + 10 + 37 + 10 + 17


def test_dense_features_follow_the_templates(spark):
    vec = lambda k: [[float(i), k] for i in range(1, 8)]
    states = state_row(spark)
    for name, k in (("wvec", 1.0), ("fvec", 2.0), ("bvec", 3.0)):
        column = F.array(*[F.array(*[F.lit(x).cast("float") for x in v]) for v in vec(k)])
        states = states.withColumn(name, column)
    row = fe.transition_features(states, ["s0c", "s0v", "s2v"]).first()
    assert row.dense == [5.0, 2.0, 5.0, 3.0, 5.0, 1.0, 0.0, 0.0]


def random_trees(k, seed=3):
    rng, out = random.Random(seed), []
    while len(out) < k:
        n = rng.randint(1, 9)
        root = rng.randint(1, n)
        out.append([0 if t == root else (t + 1 if t < root else t - 1) for t in range(1, n + 1)])
    return out


@pytest.mark.parametrize("system,beam", [(tr.HYBRID_R1, 1), (tr.HYBRID_R1, 3), (tr.EAGER, 2)])
def test_parsing_with_gold_scores_rebuilds_the_trees(sentences, system, beam):
    sents = sentences(*random_trees(12))
    parses = bm.parse(sents.select("sent_id", "n", "heads", "deprels"), tn.gold_scorer(system), system, beam)
    score = sc.las(sc.arc_matches(sents, parses)).first()
    assert score.las == 1.0 and parses.count() == 12
    assert {r.cost for r in sc.tree_cost(sc.arc_matches(sents, parses)).collect()} == {0}


def test_beam_step_keeps_the_best_legal_successors(sentences):
    sents = sentences([2, 0, 2])
    step = bm.stepper(tn.gold_scorer(), beam=3)
    one = step(bm.start_states(sents)).collect()
    assert [r.slot for r in sorted(one, key=lambda r: r.slot)] == [1, 2, 3]
    best = min(one, key=lambda r: r.slot)
    assert best.move == gold.gold_moves(sents).first().moves[0] and best.score == 0.0
    two = step(step(bm.start_states(sents))).collect()
    assert len(two) == 3 and sorted((-r.score, r.parent, r.move) for r in two) == [
        (-r.score, r.parent, r.move) for r in sorted(two, key=lambda r: r.slot)
    ]


def test_training_beats_the_majority_and_reloads(spark, sentences, tmp_path):
    sents = sentences(*random_trees(60))
    rows = tn.training_rows(sents)
    model = tn.train_moves(rows, max_iter=20)
    report = tn.move_accuracy(rows, model).first()
    assert report.accuracy > report.majority
    path = str(tmp_path / "model")
    st.save_model(path, model, tr.HYBRID_R1, an.TEMPLATES)
    again, saved = st.load_model(spark, path, tr.HYBRID_R1, an.TEMPLATES)
    assert tn.move_accuracy(rows, again).first() == report
    with pytest.raises(ValueError):
        st.load_model(spark, path, tr.EAGER)
    with pytest.raises(ValueError):
        st.load_model(spark, path, templates=["s0p"])
    parses = bm.parse(sents.select("sent_id", "n", "upos"), tn.model_scorer(again), beam=2)
    assert parses.count() == 60
    assert all(r.heads.count(0) == 1 for r in parses.collect())
    with pytest.raises(ValueError):
        tn.train_moves(rows, estimator="forest")


def test_equal_states_are_added_up(sentences):
    trees = random_trees(30)
    sents = sentences(*trees, *trees, *trees).withColumn("fold", (F.col("sent_id") % 2).cast("int"))
    rows = tn.training_rows(sents, keep=("fold",))
    plain = rows.groupBy("fold", "move", F.array_sort("feature_ids").alias("ids")).agg(F.count(F.lit(1)).alias("c"))
    want = {(r.fold, r.move, tuple(r.ids)): r.c for r in plain.collect()}
    for stretch in (7, 1 << 19):
        counts = tn.training_counts(sents, keep=("fold",), stretch=stretch)
        got = {}
        for r in counts.collect():
            ids = tuple(int(i) for i, x in zip(r.features.indices, r.features.values) for _ in range(int(x)))
            got[r.fold, r.move, ids] = got.get((r.fold, r.move, ids), 0) + r.copies
        assert got == want
    assert counts.count() < rows.count()
    one, other = tn.train_moves(rows, max_iter=5), tn.train_moves(counts, max_iter=5)
    assert tn.move_accuracy(rows, one).first() == pytest.approx(tn.move_accuracy(counts, one).first())
    gap = one.stages[-1].coefficientMatrix.toArray() - other.stages[-1].coefficientMatrix.toArray()
    assert abs(gap).max() < 0.02
    with pytest.raises(ValueError):
        tn.train_moves(counts, estimator="perceptron")


def test_the_fit_over_blocks_comes_where_spark_ml_does(sentences):
    sents = sentences(*random_trees(60)).withColumn("fold", (F.col("sent_id") % 2).cast("int"))
    rows, held = tn.training_rows(sents, keep=("fold",)), tn.training_blocks(sents, keep=("fold",), stretch=500)
    mine, other = F.col("fold") == 0, F.col("fold") == 1
    model = tn.train_moves(rows.where(mine), max_iter=60)
    [want], got = tn.model_layers(model), lo.fit(held.where(mine), fe.feature_count(), tr.move_count(tr.DEFAULT_SYSTEM), 60)
    # the bias of a move that never occurs has no bound, and scores may differ by a number that all moves share
    seen = [r.move - 1 for r in rows.where(mine).select("move").distinct().collect()]
    one, two = (np.asarray(w.weights)[:, seen] - np.asarray(w.weights)[:, seen].mean(1, keepdims=True) for w in (got, want))
    assert np.corrcoef(one.ravel(), two.ravel())[0, 1] > 0.95
    for part in (mine, other):
        hits = {r.move: (r.c, r.ok) for r in lo.hits(held.where(part), got).collect()}
        wanted = {r.move: (r.c, r.ok) for r in tn.move_hits(rows.where(part), model).collect()}
        assert {m: c for m, (c, _) in hits.items()} == {m: c for m, (c, _) in wanted.items()}
        assert abs(sum(ok for _, ok in hits.values()) - sum(ok for _, ok in wanted.values())) <= 0.03 * rows.where(part).count()


def test_minimum_of_a_bowl():
    pull, goal = np.array([1.0, 10.0, 100.0]), np.array([3.0, -2.0, 1.0])
    found = lo.minimum(lambda x: ((pull * (x - goal) ** 2).sum(), 2 * pull * (x - goal)), np.zeros(3), 60, tol=0.0)
    assert np.allclose(found, goal, atol=1e-4)


def test_parsing_inside_the_row_equals_the_loop(sentences):
    sents = sentences(*random_trees(40)).select("sent_id", "n", "upos", "heads", "deprels")
    model = tn.train_moves(tn.training_rows(sents), max_iter=10)
    plain = sents.select("sent_id", "n", "upos")
    looped = {r.sent_id: r for r in bm.parse(plain, tn.model_scorer(model)).collect()}
    in_row = {r.sent_id: r for r in bm.parse_rows(plain, tn.row_scorer(model)).collect()}
    assert looped.keys() == in_row.keys() and len(in_row) == 40
    for key, r in in_row.items():
        assert (r.heads, r.deprels) == (looped[key].heads, looped[key].deprels)
        assert r.score == pytest.approx(looped[key].score)
    other = tn.train_moves(tn.training_rows(sents, templates=["s0p"]), templates=["s0p"], max_iter=2)
    with pytest.raises(ValueError):
        tn.row_scorer(other)


def test_sums_inside_the_row_equal_sums_over_states(sentences):
    sents = sentences(*random_trees(20)).select("sent_id", "n", "heads", "deprels").where("n > 1")
    states = gold.gold_states(sents)
    want = {r.sent_id: r.s for r in states.groupBy("sent_id").agg(F.sum(F.size("state.stack") * F.col("step")).alias("s")).collect()}
    add = lambda total, state, step, best: total + F.size(state["stack"]) * step
    got = {r.sent_id: r.total for r in gold.over_states(sents, F.lit(0), add).collect()}
    assert got == want


def test_perceptron(sentences):
    templates = ["s0p", "n0p"]
    rows = tn.training_rows(sentences(*random_trees(20)), templates=templates)
    model = tn.train_moves(rows, templates=templates, estimator="perceptron", max_iter=3, hidden=(4,))
    assert tn.move_accuracy(rows, model).first().n_rows == rows.count()


def integer_scores(state):
    """A rule of move, words in focus, tags and stack."""
    size = F.size(state["stack"])
    tag = lambda at: F.coalesce(F.get("upos", at - 1), F.lit(0))
    rest = 17 * tag(F.get(state["stack"], size - 1)) + 7 * tag(state["wptr"]) + 13 * F.col("n") + 5 * size
    return F.transform(F.sequence(F.lit(1), F.lit(tr.move_count(tr.DEFAULT_SYSTEM))), lambda m: ((31 * m + rest) % 101).cast("double"))


def as_rows(parses):
    return {r.sent_id: (r.heads, r.deprels, pytest.approx(r.score)) for r in parses.collect()}


@pytest.mark.parametrize("beam", [2, 4])
def test_beam_inside_the_row_equals_the_loop(sentences, beam):
    plain = sentences([0], *random_trees(12, seed=3)).select("sent_id", "n", "upos")
    looped = bm.parse(plain, lambda states: states.withColumn("scores", integer_scores(F.col("state"))), beam=beam)
    assert as_rows(bm.parse_beam(plain, integer_scores, beam=beam)) == as_rows(looped)


def test_beam_of_one_is_the_greedy_parse(sentences):
    plain = sentences(*random_trees(15)).select("sent_id", "n", "upos")
    assert as_rows(bm.parse_beam(plain, integer_scores, beam=1)) == as_rows(bm.parse_rows(plain, integer_scores))
    assert bm.parse_beam(plain.limit(0), integer_scores).count() == 0


def vectors_of(sents, dim=3):
    vec = lambda k: F.transform("upos", lambda t, i: F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda d: ((t * d + i * k) % 7).cast("float")))
    return sents.withColumns({"wvec": vec(1), "fvec": vec(2), "bvec": vec(3)})


@pytest.mark.parametrize("estimator", ["logistic", "perceptron"])
def test_dense_templates_inside_the_row_equal_the_loop(sentences, estimator):
    sents = vectors_of(sentences(*random_trees(25)))
    rows = tn.training_rows(sents)
    model = tn.train_moves(rows, estimator=estimator, max_iter=4, hidden=(5,))
    plain = sents.select("sent_id", "n", "upos", *fe.VECTORS)
    looped = bm.parse(plain.limit(8), tn.model_scorer(model))
    assert as_rows(bm.parse_rows(plain.limit(8), tn.row_scorer(model))) == as_rows(looped)
    # the same scores state by state
    states = gold.gold_states(sents)
    both = tn.model_scorer(model)(states).withColumn("own", tn.row_scorer(model)(F.col("state")))
    gap = F.aggregate(F.zip_with("scores", "own", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: F.greatest(a, x))
    assert both.agg(F.max(gap)).first()[0] < 1e-6


def test_beam_losses_equal_the_candidates(spark, sentences):
    """A search of one step has the loss that the candidate table gives."""
    sents = sentences([2, 0], [0, 1], ([2, 0], [5, 1])).select("sent_id", "n", "upos", "heads", "deprels")
    start = bm.start_states(sents)
    rows = start.withColumn("s", integer_scores(F.col("state")))
    summary = tr.cost_summary(tr.DEFAULT_SYSTEM, F.col("state"), F.col("heads"), F.col("deprels"), F.col("n"))
    rows = rows.withColumn("c", tr.let(summary, lambda x: tr.move_costs(tr.DEFAULT_SYSTEM, x))).withColumn("ok", tr.legal_moves(tr.DEFAULT_SYSTEM, F.col("state"), F.col("n")))
    moves = rows.select("sent_id", "ok", F.posexplode(F.arrays_zip("s", "c")).alias("i", "x"))
    cands = moves.where(tr.is_legal(tr.DEFAULT_SYSTEM, F.col("i") + 1, F.col("ok"))).select(
        "sent_id", F.lit(1).alias("parent"), (F.col("i") + 1).alias("move"), F.col("x.s").alias("score"), F.lit(0).alias("parent_cost"),
        F.col("x.c").alias("move_cost"), F.lit(False).alias("is_final"),
    )
    want = {r.sent_id: r for r in ca.beam_loss(cands, 4).collect() if r.early_stop}
    got = {r.sent_id: r for r in bm.beam_losses(sents, integer_scores).collect()}
    assert want and all(got[k].early_stop and got[k].steps == 1 and got[k].loss == pytest.approx(r.loss) for k, r in want.items())


def gold_led(weight):
    """Scores that lead along the gold path more or less strongly."""

    def scores(state):
        summary = tr.cost_summary(tr.DEFAULT_SYSTEM, state, F.col("heads"), F.col("deprels"), F.col("n"))
        costs = tr.let(summary, lambda s: tr.move_costs(tr.DEFAULT_SYSTEM, s))
        return F.zip_with(costs, integer_scores(state), lambda c, s: (s % 37 - weight * c) / 8)

    return scores


def test_gold_path_stays_or_leaves_the_beam(sentences):
    sents = sentences([0], *random_trees(20)).select("sent_id", "n", "upos", "heads", "deprels")
    held = {r.sent_id: r for r in bm.beam_losses(sents, gold_led(400)).collect()}
    assert not any(r.early_stop for r in held.values())
    assert all(r.steps == 2 * r.n - 2 and r.loss >= 0 for r in held.values())
    assert held[1].loss == 0.0 and held[1].steps == 0
    lost = {r.sent_id: r for r in bm.beam_losses(sents, gold_led(0), beam=1).collect()}
    assert sum(r.early_stop for r in lost.values()) > 10
    assert all(r.loss > 0 and r.steps < 2 * r.n - 2 for r in lost.values() if r.early_stop)
    best = as_rows(bm.parse_beam(sents, gold_led(400)))
    for r in sents.collect():
        assert best[r.sent_id][0] == r.heads and best[r.sent_id][1] == r.deprels


def test_epochs_start_from_the_last_weights_and_keep_the_best_model(sentences):
    sents = sentences(*random_trees(30)).select("sent_id", "n", "upos", "heads", "deprels")
    rows = tn.training_rows(sents)
    models = []

    def score(model):
        models.append(model)
        return [0.1, 0.3, 0.2, 0.5, 0.5, 0.4][len(models) - 1]

    best, curve = tn.train_epochs(rows, score, 5, max_iter=3)
    assert len(models) == 6 and best is models[3]
    assert [(r.epoch, r.best_epoch) for r in curve.orderBy("epoch").collect()] == [(0, 0), (1, 1), (2, 1), (3, 3), (4, 3), (5, 3)]
    # training goes on where it stopped: more of the moves are right
    rights = [tn.move_accuracy(rows, m).first().accuracy for m in (models[0], models[1], models[5])]
    assert rights[0] < rights[1] < rights[2]


def test_training_stops_after_the_best_epoch(sentences):
    rows = tn.training_rows(sentences(*random_trees(5)), templates=["s0p"])
    tries = []
    tn.train_epochs(rows, lambda m: tries.append(m) or -abs(len(tries) - 3), 9, templates=["s0p"], max_iter=1, patience=1)
    # best at epoch 2; the first epoch with 1 < best < epoch - 1 is the fourth
    assert len(tries) == 5


def test_distinct_states(sentences):
    states = gold.gold_states(sentences([2, 0], [2, 0], [0, 1]).select("sent_id", "n", "heads", "deprels"))
    rows = bm.distinct_states(states).collect()
    assert sum(r.copies for r in rows) == 6
    start = [r for r in rows if r.state.wptr == 2 and r.state["head"] == [0, 0]]
    assert len(start) == 1 and start[0].copies == 3


def beam_rows(spark, seed=5):
    rng = random.Random(seed)
    rows = []
    for sent in range(1, 9):
        costs = [rng.randint(0, 1) for _ in range(3)]
        for parent in range(3):
            for move in range(1, 5):
                rows.append((sent, parent, move, rng.uniform(-800, 800), costs[parent], rng.randint(0, 2)))
    names = "sent_id long, parent int, move long, score double, parent_cost int, move_cost int"
    return rows, spark.createDataFrame(rows, names)


def test_beam_arithmetic_against_plain_python(spark):
    rows, df = beam_rows(spark)
    top, gold_rows = {}, {}
    for sent in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == sent]
        top[sent] = sorted(mine, key=lambda r: (-r[3], r[1], r[2]))[:3]
        parents = [r[1] for r in mine if r[4] == 0]
        if parents:
            first = [r for r in mine if r[1] == min(parents) and r[5] == 0]
            if first:
                gold_rows[sent] = min(first, key=lambda r: r[2])
    got = {(r.sent_id, r.slot): (r.parent, r.move) for r in ca.top_k(df, 3).collect()}
    assert got == {(s, i + 1): (r[1], r[2]) for s, v in top.items() for i, r in enumerate(v)}
    assert {r.sent_id: (r.parent, r.move) for r in ca.gold_candidate(df).collect()} == {
        s: (r[1], r[2]) for s, r in gold_rows.items()
    }
    losses = {r.sent_id: (r.early_stop, r.loss) for r in ca.beam_loss(df, 3).collect()}
    free = {s: next((r for r in mine if r[4] + r[5] == 0), None) for s, mine in top.items()}
    assert set(losses) == {s for s in top if free[s] or s in gold_rows}
    for s, (early, loss) in losses.items():
        g = free[s] or gold_rows[s]
        pool = [r[3] for r in top[s]] + ([] if free[s] else [g[3]])
        want = max(pool) + math.log(sum(math.exp(x - max(pool)) for x in pool)) - g[3]
        assert early == (free[s] is None) and math.isclose(loss, want, abs_tol=1e-9)
    sums = {r.sent_id: r.logsumexp for r in ca.logsumexp(df, ["sent_id"]).collect()}
    for s in top:
        mine = [r[3] for r in rows if r[0] == s]
        assert math.isclose(sums[s], max(mine) + math.log(sum(math.exp(x - max(mine)) for x in mine)), abs_tol=1e-9)


def test_gold_is_the_best_free_member_of_the_beam(spark):
    rows = [(1, 1, 1, 0.0, 0, 0), (1, 1, 2, 9.0, 0, 0), (1, 1, 3, 8.0, 0, 1)]
    names = "sent_id long, parent int, move long, score double, parent_cost int, move_cost int"
    df = spark.createDataFrame(rows, names)
    (r,) = ca.beam_loss(df, 2).collect()
    assert not r.early_stop and math.isclose(r.loss, math.log(1 + math.exp(-1)), abs_tol=1e-9)
    (r,) = ca.beam_loss(df.withColumn("is_final", F.lit(False)), 2).collect()
    assert not r.early_stop and r.loss == 0
