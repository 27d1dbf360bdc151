import random

import pytest
from pyspark.sql import functions as F

from arbolex.operators import batching as ba
from arbolex.operators import context_model as cm
from arbolex.operators import encoding as en
from arbolex.operators import vocabulary as vo


def test_bucket_batches_drop_the_tail_and_minibatches_keep_it(spark):
    rows = [(i, 3 if i % 3 else 5) for i in range(1, 24)]
    seqs = spark.createDataFrame(rows, "sent_id long, seq_len int")
    batches = ba.length_batches(seqs, 4).collect()
    by_batch = {}
    for r in batches:
        by_batch.setdefault((r.seq_len, r.batch_no), []).append((r.slot, r.sent_id))
    assert all(sorted(s for s, _ in v) == [0, 1, 2, 3] for v in by_batch.values())
    assert len(by_batch) == 16 // 4 + 7 // 4
    assert [i for _, i in sorted(by_batch[(5, 0)])] == [3, 6, 9, 12]
    ready = {r.seq_len: r.n_batches for r in ba.ready_buckets(seqs, 8).collect()}
    assert ready == {3: 2}
    mini = ba.minibatches(seqs.withColumnRenamed("seq_len", "n"), 4).collect()
    assert len(mini) == 23 and max(r.batch_no for r in mini) == 5
    shuffled = ba.shuffled_batches(ba.minibatches(seqs.withColumnRenamed("seq_len", "n"), 4)).collect()
    assert sorted(r.position for r in shuffled) == [1, 2, 3, 4, 5, 6]
    assert [r.batch_no for r in sorted(shuffled, key=lambda r: r.position)] != list(range(6))


def test_padding_of_ids(spark):
    df = spark.createDataFrame([(1, 2, [7, 8], 4)], "sent_id long, n int, ids array<int>, max_n int")
    row = ba.pad_token_batch(df).first()
    assert (row.padded, row["mask"]) == ([2, 2, 1, 7, 8, 2], [0, 0, 1, 1, 1, 1])
    gold = ba.pad_gold_batch(df).first()
    assert (gold.padded, gold["mask"]) == ([3, 3, 7, 8], [0, 0, 1, 1])


def test_character_batches(spark):
    vocab = spark.createDataFrame([("ab", 4), ("c?a", 5)], "word string, id int")
    chars = spark.createDataFrame([("a", 4), ("b", 5), ("c", 6)], "ch string, id int")
    batches = ba.word_batches(en.char_ids(vocab, chars), 2)
    rows = {r.id: r for r in ba.pad_char_batch(batches).collect()}
    assert (rows[4].padded, rows[4]["mask"]) == ([1, 2, 4, 5, 3], [0, 1, 1, 1, 1])
    # the unknown character has the padding id but counts as a character
    assert (rows[5].padded, rows[5]["mask"]) == ([2, 6, 1, 4, 3], [1, 1, 1, 1, 1])
    keys = {r.id: r.key for r in ba.pad_vocab_right(vocab).collect()}
    assert keys[4] == "\x12ab\x13\x11"
    whole = ba.concat_char_batch(batches, vocab).first()
    assert whole.ids == [2, 4, 5, 3, 1, 2, 6, 1, 4, 3]
    assert whole["mask"] == [1, 1, 1, 1, 0, 1, 1, 1, 1, 1]


def test_align_right_and_corpus_batches(spark):
    sents = spark.createDataFrame([(10, 2), (20, 3), (30, 1)], "sent_id long, n int")
    rows = ba.align_right(ba.corpus_batches(sents, 2)).collect()
    steps = {(r.sent_id, r.tok_id): (r.batch_no, r.step) for r in rows}
    assert steps[(10, 1)] == (0, 2) and steps[(20, 1)] == (0, 1) and steps[(30, 1)] == (1, 1)


def test_encode_decode_identity(spark):
    lines = spark.createDataFrame([(1, "the cat the dog"), (2, "a cat")], "sent_id long, line string")
    sents = vo.sentences(lines)
    counts = vo.word_counts(vo.tokens(sents).select("word"))
    out_vocab, in_vocab = vo.top_vocab(counts, 2), vo.vocab_ids(vo.ranked_words(counts))
    encoded = en.encode_dual(sents, out_vocab, in_vocab)
    row = {r.sent_id: r for r in en.decode_ids(encoded, out_vocab, in_vocab).collect()}[1]
    assert row.in_words == ["<s>", "the", "cat", "the", "dog", "</s>"]
    assert row.out_words == ["<s>", "the", "cat", "the", "<unk>", "</s>"] or "cat" not in [
        r.word for r in out_vocab.collect()
    ]
    simple = {r.sent_id: r for r in en.encode_tokens(sents, out_vocab).collect()}[1]
    assert simple.n == 4 and len(simple.ids) == 4 and simple.n_unk == simple.ids.count(3)
    major = ba.time_major(
        encoded.withColumn("batch_no", F.lit(0)).withColumn("slot", F.col("sent_id").cast("int")), "seq"
    ).where("seq_len = 6")
    assert [r.ids[0].in_id for r in major.orderBy("step").collect()] == [
        p.in_id for p in encoded.where("sent_id = 1").first().seq
    ]


def test_words_of_a_time_step_are_padded_to_its_longest(spark):
    seq = lambda *ids: [(0, i) for i in ids]
    batches = spark.createDataFrame(
        [(4, 0, 0, seq(1, 5, 6, 2)), (4, 0, 1, seq(1, 6, 7, 2)), (4, 1, 0, seq(1, 5, 5, 2)), (4, 1, 1, seq(1, 5, 5, 2))],
        "seq_len int, batch_no long, slot int, seq array<struct<out_id:int,in_id:long>>",
    )
    spelled = spark.createDataFrame(
        [(1, [9]), (2, [9, 9]), (5, [4]), (6, [5, 6, 7]), (7, [1, 8])], "id long, char_ids array<int>"
    )
    steps = ba.step_words(batches, spelled)
    rows = {(r.batch_no, r.step): r for r in ba.pad_char_steps(steps).collect()}
    assert len(rows) == 8
    assert (rows[0, 2].width, rows[0, 2].padded) == (5, [[1, 1, 2, 4, 3], [2, 5, 6, 7, 3]])
    assert rows[0, 2].mask == [[0, 0, 1, 1, 1], [1] * 5]
    # an unknown character has the padding's id but counts
    assert rows[0, 3].padded[1] == [1, 2, 1, 8, 3] and rows[0, 3].mask[1] == [0, 1, 1, 1, 1]
    assert rows[1, 2].width == 3
    whole = {(r.batch_no, r.step): r for r in ba.concat_char_steps(steps, 3).collect()}
    assert whole[0, 2]["ids"] == [2, 4, 3, 1, 1, 2, 5, 6, 7, 3] and whole[0, 2]["mask"] == [1, 1, 1, 0, 0, 1, 1, 1, 1, 1]


def test_losses_follow_the_schedule(spark):
    batches = spark.createDataFrame([(n, b, 10 * n + b) for n in (3, 4) for b in range(4)], "seq_len int, batch_no long, sent_id long")
    order = {(r.seq_len, r.batch_no): r.position for r in ba.scheduled_batches(batches).collect()}
    assert sorted(order.values()) == list(range(1, 9)) and order != {k: i for i, k in enumerate(sorted(order), 1)}
    scored = spark.createDataFrame([(r.sent_id, 2, -float(r.sent_id)) for r in batches.collect()], "sent_id long, n int, sum_logp double")
    for r in cm.batch_losses(batches, scored).collect():
        assert r["ord"] == order[r.seq_len, r.batch_no] and r.loss == (10 * r.seq_len + r.batch_no) / 2


@pytest.mark.parametrize("limit", [0, 4, 7, 1000])
def test_cold_words_come_back_to_their_places(spark, limit):
    """Ids and words are the same however many of them are looked up in the row."""
    rng = random.Random(5)
    lines = [(i, " ".join(rng.choice(["the", "a", "b", "x" * 70, f"w{rng.randint(0, 9)}"]) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    sents = vo.sentences(spark.createDataFrame(lines, "sent_id long, line string"))
    counts = vo.word_counts(vo.tokens(sents).select("word"))
    out_vocab, in_vocab = vo.top_vocab(counts, 3), vo.vocab_ids(vo.ranked_words(counts))
    ids = [{r.word: r.id for r in v.collect()} for v in (out_vocab, in_vocab)]
    encoded = en.encode_pairs(sents, out_vocab, in_vocab, limit)
    decoded = {r.sent_id: r for r in en.decode_pairs(encoded, out_vocab, in_vocab, limit).collect()}
    got = {r.sent_id: r for r in encoded.collect()}
    split = {i: line.split() for i, line in lines if line.split()}
    assert got.keys() == decoded.keys() == split.keys()
    for i, words in split.items():
        assert got[i].seq_len == len(words) + 2
        for have, named, vocab in ((got[i].out_ids, decoded[i].out_words, ids[0]), (got[i].in_ids, decoded[i].in_words, ids[1])):
            assert have == [1, *[vocab.get(w, 3) for w in words], 2]
            assert named == ["<s>", *[w if w in vocab else "<unk>" for w in words], "</s>"]


def test_sequences_of_a_batch_meet_whole(spark):
    """The transpose shuffles a row per sequence and not per cell, and gives each column."""
    rows = [(4, b, s, [10 * s + i for i in range(4)], [100 * b + i for i in range(4)]) for b in range(3) for s in range(2)]
    batches = spark.createDataFrame(rows, "seq_len int, batch_no long, slot int, a array<int>, b array<long>")
    out = ba.time_major(batches, "a", "b")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # cells are made above the only aggregate
    got = {(r.batch_no, r.step): (r.a, r.b) for r in out.collect()}
    assert got == {(b, i + 1): ([i, 10 + i], [100 * b + i] * 2) for b in range(3) for i in range(4)}
    assert ba.time_major(batches.limit(0), "a").count() == 0
