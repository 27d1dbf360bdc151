import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arbolex.functions import text as tx
from arbolex.operators import batching as ba
from arbolex.operators import context_model as cm
from arbolex.operators import scores as sc
from arbolex.operators import series as se
from arbolex.operators import vectors as ve
from arbolex.operators import vocabulary as vo
from arbolex.sources import store as st


def text_sents(spark, texts):
    rows = [(i, i % 2, t) for i, t in enumerate(texts, 1)]
    return vo.sentences(spark.createDataFrame(rows, "sent_id long, fold int, line string"))


def brute_logp(train, v, l, w, r):  # noqa: E741
    c = Counter(train)
    n = len(train)

    def count(**kw):
        return sum(k for (a, b, d), k in c.items() if kw.get("l", a) == a and kw.get("w", b) == b and kw.get("r", d) == d)

    def share(a, b):
        return a / b if b else 0.0

    p = 0.5 * share(count(l=l, w=w, r=r), count(l=l, r=r)) + 0.15 * share(count(l=l, w=w), count(l=l))
    p += 0.15 * share(count(w=w, r=r), count(r=r)) + 0.2 * (count(w=w) + 0.1) / (n + 0.1 * v)
    return math.log(p)


def test_context_model_against_plain_python(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 8))) for _ in range(30)]
    sents = text_sents(spark, texts)
    counts = vo.word_counts(vo.tokens(sents).select("word"))
    vocab = vo.top_vocab(counts, 5)
    ids = {r.word: r.id for r in vocab.collect()}
    ctx, scored = cm.cross_fitted(sents, vocab)
    grams = {0: [], 1: []}
    per_token = {}
    for i, t in enumerate(texts, 1):
        seq = [1, *[ids.get(w, 3) for w in t.split()], 2]
        for k in range(1, len(seq) - 1):
            grams[i % 2].append((seq[k - 1], seq[k], seq[k + 1]))
            per_token[(i, k)] = (i % 2, seq[k - 1], seq[k], seq[k + 1])
    got = cm.token_logprob(ctx, scored, ["fold"]).collect()
    assert len(got) == len(per_token)
    for r in got:
        fold, l, w, rr = per_token[(r.sent_id, r.tok_id)]  # noqa: E741
        assert math.isclose(r.logp, brute_logp(grams[1 - fold], len(ids), l, w, rr), rel_tol=1e-9)
    logs = [r.logp for r in got]
    assert math.isclose(cm.perplexity(scored).first().perplexity, math.exp(-sum(logs) / len(logs)), rel_tol=1e-9)
    levels = {(r.kind, r.l, r.w, r.r): r.n for r in cm.context_counts(cm.trigram_counts(ctx)).collect()}
    everything = Counter(grams[0] + grams[1])
    assert levels[("_w_", 0, 3, 0)] == sum(n for (_, w, _), n in everything.items() if w == 3)
    assert sum(n for k, n in levels.items() if k[0] == "lwr") == len(logs)


def test_macro_perplexity_weighs_batches_equally(spark):
    rows = [(3, 0, 1, -2.0), (3, 0, 3, -3.0), (4, 0, 2, -8.0)]
    df = spark.createDataFrame(rows, "seq_len int, batch_no int, n int, sum_logp double")
    assert math.isclose(cm.perplexity_macro(df).first().perplexity, math.exp((5 / 4 + 8 / 2) / 2))


def plain_running(xs, warm, decay, k=0, avg=0.0):
    out = []
    for x in xs:
        k += 1
        avg = (x + (k - 1) * avg) / k if k < warm else avg * decay + x * (1 - decay)
        out.append(avg)
    return out


@pytest.mark.parametrize("warm,decay", [(100, 0.99), (1000, 0.999), (5, 0.5)])
def test_running_loss_against_a_plain_loop(spark, warm, decay):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.7 else "cold", i, rng.uniform(-5, 50)) for i in range(1500)]
    df = spark.createDataFrame(rows, "series string, ord long, loss double").repartition(5)
    got = se.running_loss(df, warm, decay).collect()
    by = {s: sorted((r for r in got if r.series == s), key=lambda r: r.k) for s in ("hot", "cold")}
    for s, rs in by.items():
        want = plain_running([x for t, _, x in rows if t == s], warm, decay)
        assert [r.k for r in rs] == list(range(1, len(want) + 1))
        assert all(math.isclose(r.avg_loss, w, rel_tol=1e-9) for r, w in zip(rs, want))


def test_running_loss_over_many_chunks(spark):
    xs = [math.sin(i) * 10 for i in range(900)]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(xs)], "series string, ord long, loss double")
    got = sorted(se.running_loss(df, 10, 0.5, chunk=40, carries=30).collect(), key=lambda r: r.k)
    assert all(math.isclose(r.avg_loss, w, rel_tol=1e-9, abs_tol=1e-12) for r, w in zip(got, plain_running(xs, 10, 0.5)))


@pytest.mark.parametrize("cut", [30, 99, 150])
def test_running_loss_goes_on_from_a_start(spark, cut):
    xs = [float((i * 37) % 101) for i in range(400)]
    want = plain_running(xs, 100, 0.99)
    rest = spark.createDataFrame([("s", i, x) for i, x in enumerate(xs) if i >= cut], "series string, ord long, loss double")
    start = spark.createDataFrame([("s", cut, want[cut - 1])], "series string, k0 long, avg0 double")
    got = sorted(se.running_loss(rest, start=start).collect(), key=lambda r: r.k)
    assert got[0].k == cut + 1
    assert all(math.isclose(r.avg_loss, w, rel_tol=1e-9) for r, w in zip(got, want[cut:]))


def test_best_epoch_needs_strict_improvement_and_stops(spark):
    scores = [0.1, 0.2, 0.2, 0.3, 0.1, 0.1, 0.1, 0.9, 0.9, *[0.5] * 8]
    df = spark.createDataFrame(list(enumerate(scores)), "epoch int, score double")
    rows = sc.best_epochs(df).orderBy("epoch").collect()
    assert [r.best_epoch for r in rows][:9] == [0, 1, 1, 3, 3, 3, 3, 7, 7]
    assert [r.epoch for r in rows if r.stops_here] == [13]
    assert [r.epoch for r in rows if r.trained] == list(range(14))


def test_las_and_tree_cost(spark, sentences):
    gold_sents = sentences(([2, 0, 2], [5, 1, 6]))
    pred = sentences(([2, 0, 1], [5, 1, 6]))
    m = sc.arc_matches(gold_sents, pred)
    assert sc.las(m).first().n_correct == 2 and sc.tree_cost(m).first().cost == 1


def test_context_vectors_against_plain_python(spark):
    vecs = [[float(i), float(i * i)] for i in range(1, 7)]
    df = spark.createDataFrame([(1, vecs)], "sent_id long, wvec array<array<float>>")
    row = ve.context_vectors(df, 2, 2).first()

    def mean(part):
        return [sum(c) / len(part) for c in zip(*part)] if part else [0.0, 0.0]

    assert row.fvec == [mean(vecs[max(0, i - 2) : i]) for i in range(6)]
    assert row.bvec == [mean(vecs[i + 1 : i + 3]) for i in range(6)]


def test_gathered_and_trained_vectors(spark):
    sents = text_sents(spark, ["a b a", "b c rare", "a a"])
    toks = vo.tokens(sents).select("sent_id", "tok_id", "word")
    vocab = vo.word_counts(toks.select("word")).withColumn("vec_id", F.ascii("word"))
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(97, 123)], "vec_id int, vec array<float>")
    got = {(r.sent_id, r.tok_id): r.vec[0] for r in ve.gather_vectors(toks, vocab, vectors).collect()}
    assert len(got) == 8 and got[(1, 2)] == 98.0
    counts = vo.word_counts(toks.select("word"))
    known = ve.map_to_known(sents, vo.top_vocab(counts, 2))
    model = ve.train_word_vectors(known, size=4)
    words = {r.word: r.vec for r in ve.word_vectors(model).collect()}
    assert set(words) == {"a", "b", tx.UNK} and all(len(v) == 4 for v in words.values())
    nested = ve.sentence_vectors(toks, ve.word_vectors(model)).where("sent_id = 2").first()
    assert nested.wvec[1] == words[tx.UNK] and nested.wvec[0] == words["b"]


def test_vocabularies_reload_with_builtin_tables(spark, tmp_path):
    counts = spark.createDataFrame([("b", 2), ("a", 5)], "word string, n long")
    path = str(tmp_path / "v")
    st.save_vocabularies(path, vo.top_vocab(counts), vo.char_vocab(vo.ranked_words(counts)))
    back = st.load_vocabularies(spark, path)
    assert back["tags"].count() == 17 and back["labels"].count() == 37
    assert back["meta"].first().unk == "<unk>" and back["word_vocab"].count() == 5
    own = spark.createDataFrame([("T", 1)], "tag string, id int")
    st.save_vocabularies(path, vo.top_vocab(counts), vo.char_vocab(vo.ranked_words(counts)), tags=own)
    assert st.load_vocabularies(spark, path)["tags"].count() == 1


def test_seeded_choices_are_reproducible(spark):
    buckets = spark.createDataFrame([(i, 30) for i in range(3, 20)], "seq_len int, n_seq long")
    picks = {ba.pick_bucket(buckets, seed).first().seq_len for seed in range(8)}
    assert len(picks) > 1
    assert ba.pick_bucket(buckets, 4).first() == ba.pick_bucket(buckets.repartition(3), 4).first()
