import pytest
from pyspark.sql import functions as F

from arbolex.functions.labels import DEPREL, UPOS
from arbolex.operators import treebank as tb
from arbolex.sources import conllu as co


def word(i, form, tag="NOUN", head="0", label="root", misc="_"):
    return "\t".join([str(i), form, "_", tag, "_", "_", head, label, "_", misc])


FIRST = "\n".join(
    [
        "# text = a b c",
        word("1-2", "ab", "_", "_", "_"),
        word(1, "a", "DET", "2", "nsubj:pass", "SpaceAfter=No|X:Y"),
        word("1.1", "ghost", "X", "_", "_"),
        word(2, "b", "VERB", "0", "root"),
        word(3, "c", "NOUN", "2", "obj"),
    ]
)
BAD = "\n".join([word(1, "x", "WAT", "_", "huh"), word(2, "y", "NOUN", "1", "root")])
TAIL = word(1, "last", "NOUN", "0", "root")


def read(spark, tmp_path, text, name="f.conllu", **kw):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return co.read_conllu(spark, str(path), **kw).orderBy("sent_id").collect()


def test_scan_skips_ranges_empty_nodes_and_subtypes(spark, tmp_path):
    row = read(spark, tmp_path, FIRST + "\n\n")[0]
    assert row.forms == ["a", "b", "c"] and row.heads == [2, 0, 2]
    assert [UPOS[u - 1] for u in row.upos] == ["DET", "VERB", "NOUN"]
    assert [DEPREL[d - 1] for d in row.deprels] == ["nsubj", "root", "obj"]


def test_unknown_values_and_quarantine(spark, tmp_path):
    row = read(spark, tmp_path, BAD + "\n\n")[0]
    assert (row.upos, row.heads, row.deprels) == ([0, 8], [-1, 1], [0, 1])
    path = tmp_path / "q.conllu"
    path.write_text(FIRST + "\n\n" + BAD + "\n\n")
    sents = co.read_conllu(spark, str(path))
    report = tb.quality(sents).first()
    assert (report.n_sent, report.n_tok) == (2, 5)
    assert (report.bad_tag, report.bad_head, report.bad_label, report.bad_root, report.n_set_aside) == (1, 1, 1, 1, 1)
    assert tb.sound(sents).count() == 1


@pytest.mark.parametrize("ending", ["", "\n"])
def test_open_tail_is_dropped_unless_kept(spark, tmp_path, ending):
    text = FIRST + "\n\n" + TAIL + ending
    assert [r.forms for r in read(spark, tmp_path, text)] == [["a", "b", "c"]]
    assert [r.forms for r in read(spark, tmp_path, text, keep_tail=True)] == [["a", "b", "c"], ["last"]]
    closed = read(spark, tmp_path, text.rstrip("\n") + "\n\n", name="closed.conllu")
    assert [r.forms for r in closed] == [["a", "b", "c"], ["last"]]


def test_double_blank_line_gives_no_empty_sentence(spark, tmp_path):
    rows = read(spark, tmp_path, FIRST + "\n\n\n" + TAIL + "\n\n")
    assert [r.forms for r in rows] == [["a", "b", "c"], ["last"]]


def test_several_files_are_concatenated_in_order(spark, tmp_path):
    (tmp_path / "a.conllu").write_text(TAIL + "\n\n")
    (tmp_path / "b.conllu").write_text(FIRST + "\n\n" + TAIL + "\n\n")
    rows = co.read_conllu(spark, [str(tmp_path / "a.conllu"), str(tmp_path / "b.conllu")]).orderBy("sent_id").collect()
    assert [(r.sent_id, r.n) for r in rows] == [(1, 1), (2, 3), (3, 1)]


def sink_inputs(spark, text=FIRST):
    blocks = spark.createDataFrame([(1, text)], "sent_id long, block string")
    lines = co.block_lines(blocks)
    preds = spark.createDataFrame(
        [(1, 1, "a", 3, 28), (1, 2, "b", 3, 2), (1, 3, "c", 0, 1)],
        "sent_id long, tok_id int, form string, head int, deprel int",
    )
    return lines, preds


def test_sink_replaces_only_head_and_label(spark, tmp_path):
    lines, preds = sink_inputs(spark)
    out = [r.raw for r in co.rewrite_lines(lines, preds).orderBy("line_no").collect()]
    source = FIRST.split("\n")
    assert out[0] == source[0] and out[1] == source[1] and out[3] == source[3]
    assert out[2] == word(1, "a", "DET", "3", "nsubj", "SpaceAfter=No|X:Y")
    assert out[5] == word(3, "c", "NOUN", "0", "root")
    path = str(tmp_path / "out")
    co.write_conllu(co.rewrite_lines(lines, preds), path)
    again = co.read_conllu(spark, path).first()
    assert again.heads == [3, 3, 0]


def test_sink_mismatches_are_errors(spark):
    lines, preds = sink_inputs(spark)
    extra = preds.unionByName(preds.limit(1).withColumn("tok_id", F.lit(4)))
    for bad in (preds.where("tok_id < 3"), extra, preds.withColumn("form", F.lit("zzz"))):
        with pytest.raises(Exception, match="prediction|form differs"):
            co.rewrite_lines(lines, bad).collect()


def test_lines_out_of_order_are_an_error(spark):
    same = "\n".join(word(t, "a", "DET", "0", "root") for t in (1, 2))
    swapped = "\n".join(word(t, "a", "DET", "0", "root") for t in (2, 1))
    guess = spark.createDataFrame([(1, ["a", "a"], [2, 0], [28, 1])], "sent_id long, forms array<string>, heads array<int>, deprels array<int>")
    blocks = lambda text: spark.createDataFrame([(1, text)], "sent_id long, block string")
    assert co.rewrite_blocks(blocks(same), guess).first().block.split("\n")[0] == word(1, "a", "DET", "2", "nsubj")
    with pytest.raises(Exception, match="out of order"):
        co.rewrite_blocks(blocks(swapped), guess).collect()
    with pytest.raises(Exception, match="prediction without a word line"):
        co.rewrite_blocks(blocks(same), guess.union(guess.selectExpr("2L", "forms", "heads", "deprels"))).collect()
    with pytest.raises(Exception, match="word line without a prediction"):
        co.rewrite_blocks(blocks(same), guess.limit(0)).collect()
    assert co.rewrite_blocks(blocks("# only a comment"), guess.limit(0)).first().block == "# only a comment"


def test_splits_inside_a_file_keep_the_numbers(spark, tmp_path):
    text = "".join(f"# s{i}\n" + word(1, f"w{i}", "X", "0", "root") + "\n\n" for i in range(300)) + word(1, "open", "X", "0", "root") + "\n"
    for name in ("a.conllu", "b.conllu"):
        (tmp_path / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900b")
    try:
        for tail, each in ((False, 300), (True, 301)):
            rows = co.read_conllu(spark, str(tmp_path), keep_tail=tail).orderBy("sent_id").collect()
            assert [r.sent_id for r in rows] == list(range(1, 2 * each + 1))
            assert [r.forms[0] for r in rows[: each - 1]] == [f"w{i}" for i in range(each - 1)]
            old = co.number_blocks(co.sentence_blocks(spark, str(tmp_path), tail)).orderBy("sent_id").collect()
            assert [(r.sent_id, r.block) for r in old] == [(r.sent_id, r.block) for r in co.placed_blocks(spark, str(tmp_path), tail).orderBy("sent_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_long_and_nested_forms(spark, sentences):
    sents = sentences([2, 0, 2], [0])
    back = co.nested_rows(co.token_rows(sents)).orderBy("sent_id").collect()
    assert [(r.n, r.heads) for r in back] == [(3, [2, 0, 2]), (1, [0])]


def test_dependents_valency_and_ancestors(spark, sentences):
    sents = sentences([3, 3, 0, 3, 3, 5])
    tokens = co.token_rows(sents)
    deps = {r["head"]: (r.ldeps, r.rdeps) for r in tb.dependents(tokens).collect()}
    assert deps == {3: ([1, 2], [5, 4]), 5: ([], [6])}
    val = {r.tok_id: (r.left_bucket, r.right_bucket) for r in tb.valency(tokens).collect()}
    assert val[3] == (3, 3) and val[5] == (1, 2) and val[1] == (1, 1)
    heads = {r.tok_id: (r.head1, r.head2) for r in tb.ancestors(sents).collect()}
    assert heads[6] == (5, 3) and heads[1] == (3, None) and heads[3] == (None, None)
    loop = tokens.withColumn("head", F.col("tok_id"))
    with pytest.raises(Exception, match="own head"):
        tb.dependents(loop).collect()


def test_vector_sums(spark, sentences):
    tokens = co.token_rows(sentences(([2, 0, 2, 2], [2, 1, 3, 3])))
    vecs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 38)], "deprel int, vec array<double>")
    row = tb.vector_sums(tokens, vecs).first()
    assert (row.left_sum, row.right_sum) == ([2.0, 1.0], [6.0, 2.0])


def test_vectors_of_other_numbers_are_left_alone(spark, sentences):
    tokens = co.token_rows(sentences(([2, 0, 2, 2], [2, 1, 3, 3])))
    rows = [(i, [float(i), 1.0]) for i in range(1, 38)] + [(i, [0.0, 0.0]) for i in range(38, 500)] + [(0, [1.0, 1.0])]
    vecs = spark.createDataFrame(rows, "deprel int, vec array<double>")
    row = tb.vector_sums(tokens, vecs).first()
    assert (row.left_sum, row.right_sum) == ([2.0, 1.0], [6.0, 2.0])
    with pytest.raises(ValueError):
        tb.vector_sums(tokens, vecs.union(vecs.where("deprel = 3")))
