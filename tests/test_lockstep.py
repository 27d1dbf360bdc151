"""The rules over arrays next to the column expressions, and plans that compute a treebank's arrays once."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arbolex.functions import anchors as an
from arbolex.functions import lockstep as ls
from arbolex.functions import transitions as tr
from arbolex.functions.layers import Layer
from arbolex.operators import beam as bm
from arbolex.operators import features as fe
from arbolex.operators import gold
from arbolex.operators import training as tn
from arbolex.operators import treebank as tb
from arbolex.operators import vectors as ve
from arbolex.operators import vocabulary as vo
from arbolex.plans import views as vw
from tests.test_parsing import as_rows, gold_led, integer_scores


def forest(rng, n):
    """Any heads at all, crossing arcs and several roots included."""
    heads = [rng.choice([h for h in range(n + 1) if h != i]) for i in range(1, n + 1)]
    return heads, [1 if h == 0 else rng.randint(1, 37) for h in heads]


@pytest.fixture(scope="module")
def forests(spark):
    rng = random.Random(7)
    rows = [(i, n, [rng.randint(1, 17) for _ in range(n)], *forest(rng, n)) for i, n in enumerate([1, 2, 40, *[rng.randint(1, 12) for _ in range(60)]])]
    return spark.createDataFrame(rows, "sent_id long, n int, upos array<int>, heads array<int>, deprels array<int>").repartition(3)


@pytest.mark.parametrize("system", tr.SYSTEMS)
def test_states_follow_the_column_expressions(forests, system):
    """Moves, costs and legality of every state against the expressions over the same state."""
    sents = forests.select("sent_id", "n", "heads", "deprels")
    states = gold.gold_states(sents, system)
    summary = tr.cost_summary(system, F.col("state"), F.col("heads"), F.col("deprels"), F.col("n"))
    found = states.withColumn("want", tr.let(summary, lambda s: tr.best_move(system, s)))
    found = found.withColumn("next", tr.apply_move(system, F.col("state"), F.col("move"))).collect()
    at = {(r.sent_id, r.step): r for r in found}
    assert len(at) == sum(2 * r.n - 2 for r in sents.collect())
    for r in found:
        assert (r.want.cost, r.want.move) == (r.cost, r.move)
        after = at.get((r.sent_id, r.step + 1))
        assert r.next.wptr > r.n - 1 if after is None else after.state == r.next
    names = ["n_legal", "cost_sum", "n_shift", "n_right"]

    def visit(now, _step, _cost, _move):
        costs, ok = now.move_costs(), now.legality()
        legal = costs < tr.ILLEGAL
        return legal.sum(1), (costs * legal).sum(1), ok["shift"], ok["right"]

    got = {r.sent_id: tuple(r.total) for r in gold.sums_over_states(sents.where("n > 1"), names, visit, system=system).collect()}
    costs = F.filter(tr.let(summary, lambda s: tr.move_costs(system, s)), lambda c: c < tr.ILLEGAL)
    ok = tr.legal_moves(system, F.col("state"), F.col("n"))
    rows = states.select("sent_id", costs.alias("costs"), ok.alias("ok")).groupBy("sent_id").agg(
        F.sum(F.size("costs")), F.sum(F.aggregate("costs", F.lit(0), lambda a, c: a + c)), F.sum(F.col("ok.shift").cast("int")),
        F.sum(F.col("ok.right").cast("int")),
    )
    assert got == {r[0]: tuple(r[1:]) for r in rows.collect()}


def test_replay_ends_where_the_moves_lead_and_refuses_illegal_ones(forests):
    runs = gold.gold_moves(forests)
    for r in gold.replay(runs).collect():
        assert (r.end["head"], r.end.deprel, r.end.stack, r.end.wptr) == (r["head"], r.deprel, r.end.stack[:1], max(2, r.n + 1))
    with pytest.raises(Exception, match="illegal move"):
        gold.replay(runs.withColumn("moves", F.array(F.lit(3)))).collect()


def test_blocks_are_bounded_and_hold_every_row():
    n = ls.np.array([5, 100_000, 3, 200_000, 1])
    parts = list(ls.blocks(n))
    assert sorted(ls.np.concatenate(parts).tolist()) == [0, 1, 2, 3, 4] and [len(p) for p in parts][0] == 1
    empty = ls.by_blocks(None, pa.int32(), pa.array([], pa.int32()))
    assert len(empty) == 0


def test_faults_do_not_compute_the_syntax_again(spark):
    """The arrays stood in the plan once for each fault and once behind the filter."""
    sents = vw.with_syntax(spark.createDataFrame([(1, 2, ["a", "bc"])], "sent_id long, n int, forms array<string>"))
    plan = tb.sound(sents)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(forms") == 3
    assert tb.sound(sents).count() == 1


@pytest.mark.parametrize("system", tr.SYSTEMS)
def test_features_follow_the_column_expressions(forests, system):
    templates = [*an.TEMPLATES, "s0l2p", "s1r2L", "s0lhA", "s0hB", "s2d", "n2p", "n0l2b"]
    vec = lambda k: F.transform("upos", lambda t, i: F.array(t * k, i % 3, F.lit(k)).cast("array<double>"))
    sents = forests.withColumns({"wvec": vec(1), "fvec": vec(2), "bvec": vec(3)})
    rows = fe.transition_features(gold.gold_states(sents, system), templates)
    want = {(r.sent_id, r.step): (r.move, r.feature_ids, r.dense) for r in rows.collect()}
    got = {(r.sent_id, r.step): (r.move, r.feature_ids, r.dense) for r in tn.training_rows(sents, system, templates).collect()}
    assert got == want and len(got) > 500
    layers = [
        Layer([[((7 * i + 3 * k) % 11 - 5) / 64 for k in range(3)] for i in range(fe.feature_count() + 36)], [0.5, 0.25, 0.0]),
        Layer([[0.5, -1.0], [1.0, 0.25], [-0.5, 2.0]], [0.0, 0.125]),
    ]
    score = tn.state_scorer(layers)
    sums = gold.sums_over_states(sents.where("n > 1"), ("a", "b"), lambda now, *_: score(now).T, ("upos", *fe.VECTORS), system, "double")
    scores = tn.layer_scorer(layers)(F.col("state"))
    plain = gold.gold_states(sents, system).select("sent_id", scores.alias("s")).groupBy("sent_id").agg(F.sum(F.get("s", F.lit(0))), F.sum(F.get("s", F.lit(1))))
    plain = {r[0]: pytest.approx((r[1], r[2])) for r in plain.collect()}
    assert {r.sent_id: tuple(r.total) for r in sums.collect()} == plain


def block_scores(states):
    """``integer_scores`` over the arrays."""
    rest = 17 * states.at("upos", states.at("stack", states["size"])) + 7 * states.at("upos", states["wptr"]) + 13 * states["n"] + 5 * states["size"]
    return (31 * ls.np.arange(1, tr.move_count(tr.DEFAULT_SYSTEM) + 1) + rest[:, None]) % 101.0


@pytest.mark.parametrize("beam", [1, 3, 4])
def test_beams_in_step_equal_beams_in_the_row(forests, beam):
    found = bm.parse_blocks(forests, block_scores, beam=beam)
    assert as_rows(found) == as_rows(bm.parse_beam(forests, integer_scores, beam=beam))
    assert bm.parse_blocks(forests.limit(0), block_scores).count() == 0


@pytest.mark.parametrize("weight", [0, 20, 400])
def test_losses_in_step_equal_losses_in_the_row(forests, weight):
    led = lambda states: (block_scores(states) % 37 - weight * states.move_costs()) / 8
    key = lambda r: (r.sent_id, r.n, r.steps, r.early_stop, pytest.approx(r.loss))
    got = {r.sent_id: key(r) for r in bm.block_losses(forests, led).collect()}
    assert got == {r.sent_id: key(r) for r in bm.beam_losses(forests, gold_led(weight)).collect()}


@pytest.mark.parametrize("system", tr.SYSTEMS)
def test_packed_states_count_as_the_states_do(spark, forests, system):
    rows = forests.select("n", "heads", "deprels")
    rows = rows.union(rows).union(spark.createDataFrame([(260, [0, *range(1, 260)], [1, *[2] * 259])] * 2, rows.schema))
    copies = lambda states, key: sorted(tuple(r) for r in states.groupBy("n", key).agg(F.sum("copies").alias("c")).select("n", "c").collect())
    want = gold.gold_states(rows, system).withColumn("copies", F.lit(1))
    assert copies(gold.packed_states(rows, system), "packed") == copies(want, "state")


def test_context_summaries_are_those_of_the_context_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice(["a", "b", "c", "x", "<unk>"]) for _ in range(n)]) for i, n in enumerate([1, 2, 3, 9, 5000, 20_000])]
    sents = spark.createDataFrame(rows, "sent_id long, words array<string>").withColumn("n", F.size("words"))
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.5, -1.0]), ("c", [4.0, 8.0]), ("<unk>", [0.25, 0.125])], "word string, vec array<float>")
    nested = ve.context_vectors(ve.sentence_vectors(vo.tokens(sents), vectors), 2, 2)
    want = nested.select("sent_id", F.posexplode(F.arrays_zip("fvec", "bvec")).alias("pos", "v"))
    want = {(r.sent_id, r.pos + 1): (pytest.approx(sum(r.v.fvec)), pytest.approx(r.v.bvec[1])) for r in want.collect()}
    found = ve.context_summaries(sents, vectors, 2, {"sum": lambda v: v.sum(1), "last": lambda v: v[:, -1]})
    assert {(r.sent_id, r.tok_id): (r.left_sum, r.right_last) for r in found.collect()} == want
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
