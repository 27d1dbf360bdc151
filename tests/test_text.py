from pyspark.sql import functions as F

from arbolex.functions import text as tx
from arbolex.operators import vocabulary as vo
from arbolex.operators.joins import if_small
from arbolex.sources import text as sx


def lines_df(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "sent_id long, line string")


def write_file(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_lines_and_tokens(spark):
    docs = spark.createDataFrame([(7, "a  b\tc\n\n d\x0be ")], "doc_id long, text string")
    lines = sx.text_lines(docs)
    assert [(r.sent_id, r.line_no, r.line) for r in lines.orderBy("line_no").collect()] == [
        (7 * sx.LINE_STRIDE + 1, 1, "a  b\tc"), (7 * sx.LINE_STRIDE + 2, 2, ""), (7 * sx.LINE_STRIDE + 3, 3, " d\x0be "),
    ]
    toks = vo.tokens(vo.sentences(lines)).orderBy("sent_id", "tok_id").collect()
    assert [(r.sent_id, r.tok_id, r.word) for r in toks] == [
        (7 * sx.LINE_STRIDE + 1, 1, "a"), (7 * sx.LINE_STRIDE + 1, 2, "b"), (7 * sx.LINE_STRIDE + 1, 3, "c"), (7 * sx.LINE_STRIDE + 3, 1, "d"), (7 * sx.LINE_STRIDE + 3, 2, "e"),
    ]


def test_word_list_rules(spark, tmp_path):
    long = "x" * 70
    text = "\n".join(["b", "", "two words", "b", "<unk>", long, long[:65], " lead", "a\x12z"]) + "\n"
    words = sx.read_words(spark, write_file(tmp_path, "words.txt", text))
    ids = {r.word: r.id for r in vo.vocab_ids(words).collect()}
    assert ids == {
        "<s>": 1, "</s>": 2, "<unk>": 3, "b": 4, "two": 5, long[:65]: 6, "lead": 7, "a\x12z": 8,
    }
    report = vo.vocab_quality(sx.read_lines(spark, write_file(tmp_path, "again.txt", text))).first()
    assert (report.n_blank, report.n_multi, report.n_long, report.n_kept) == (1, 1, 1, 8)


def test_several_word_files_keep_file_order(spark, tmp_path):
    (tmp_path / "d").mkdir()
    write_file(tmp_path / "d", "1.txt", "z\ny\n")
    write_file(tmp_path / "d", "2.txt", "a\nz\n")
    ids = {r.word: r.id for r in vo.vocab_ids(sx.read_words(spark, str(tmp_path / "d"))).collect()}
    assert (ids["z"], ids["y"], ids["a"]) == (4, 5, 6)


def test_count_file_roundtrip(spark, tmp_path):
    counts = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "word string, n long")
    path = str(tmp_path / "counts")
    sx.write_counts(counts, path)
    rows = sx.read_counts(spark, path).orderBy("pos").collect()
    assert [(r.n, r.word) for r in rows] == [(9, "c"), (2, "a"), (2, "b")]
    bad = sx.read_counts(spark, write_file(tmp_path, "bad.txt", "x y\n")).first()
    assert bad.n is None


def test_character_vocabulary_first_seen(spark):
    words = spark.createDataFrame([(1, "cab"), (2, "a\x11é"), (3, "zz")], "pos int, word string")
    ids = {r.ch: r.id for r in vo.char_vocab(words).collect()}
    assert ids == {tx.PAD: 1, tx.SOW: 2, tx.EOW: 3, "c": 4, "a": 5, "b": 6, "é": 7, "z": 8}
    assert "z" not in {r.ch for r in vo.char_vocab(words, limit=2).collect()}
    report = vo.reserved_char_report(words.withColumn("n", F.lit(5).cast("long"))).first()
    assert (report.n_reserved_words, report.n_reserved_tokens) == (1, 5)


def test_top_n_and_coverage(spark):
    counts = spark.createDataFrame([("b", 2), ("a", 2), ("c", 6)], "word string, n long")
    assert [(r.word, r["rank"]) for r in vo.top_n(counts, 2).orderBy("rank").collect()] == [("c", 1), ("a", 2)]
    assert vo.coverage(counts, 2).first().coverage == 80.0
    curve = vo.coverage_curve(counts).orderBy("rank").collect()
    assert [(r.word, r.covered, r.coverage) for r in curve] == [("c", 6, 60.0), ("a", 8, 80.0), ("b", 10, 100.0)]
    vocab = vo.top_vocab(counts, 1)
    assert vo.unknown_rate(counts, vocab).first().unknown == 4
    assert {r.word for r in vo.oov_words(counts, vocab).collect()} == {"a", "b"}


def test_top_n_has_one_type_for_every_size(spark):
    counts = spark.createDataFrame([("b", 2), ("a", 2), ("c", 6)], "word string, n long")
    assert {(r.word, r["rank"]) for r in vo.top_n(counts, 2).collect()} == {("c", 1), ("a", 2)}
    assert vo.top_n(counts, 2).dtypes == vo.top_n(counts, 10**9).dtypes


def test_top_vocab_cuts_long_words_first(spark):
    counts = spark.createDataFrame([("x" * 65 + "a", 2), ("x" * 65 + "b", 2), ("c", 3)], "word string, n long")
    assert {(r.word, r.id) for r in vo.top_vocab(counts, 1).collect() if r.id > 3} == {("x" * 65, 4)}


def test_long_documents_and_late_characters(spark):
    text = "\n".join(["a"] * 100_001 + ["z"])
    lines = sx.text_lines(spark.createDataFrame([(7, text)], "doc_id long, text string"))
    assert lines.agg({"sent_id": "max"}).first()[0] == 7 * sx.LINE_STRIDE + 100_002
    words = spark.range(40_002).selectExpr("id AS pos", "CASE WHEN id = 40001 THEN 'ω' ELSE 'a' END AS word")
    assert {r.ch: r.id for r in vo.char_vocab(words).collect()}["ω"] == 5


def test_broadcasts_follow_a_counted_size(spark):
    big, small = spark.range(50).toDF("id"), spark.range(5).toDF("id")
    assert "broadcast" in if_small(small, 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in if_small(big, 10)._jdf.queryExecution().logical().toString().lower()


def test_length_filters(spark):
    sents = spark.createDataFrame([(1, 1), (2, 26), (3, 27), (4, 70)], "sent_id long, n int")
    assert {r.sent_id for r in vo.length_filter(sents).collect()} == {1, 2}
    assert {r.sent_id for r in vo.length_filter(sents, min_words=3).collect()} == {2}
    assert {r.sent_id for r in vo.training_filter(sents).collect()} == {2, 3}
    try:
        vo.training_filter(sents, 100, 200)
    except ValueError:
        pass
    else:
        raise AssertionError("an empty training set must fail")


def test_context_windows(spark):
    row = vo.context_windows(vo.sentences(lines_df(spark, "ab c def"))).orderBy("tok_id").collect()
    assert [(r.left_word, r.right_word, r.n_left, r.n_right, r.left_chars, r.right_chars) for r in row] == [
        ("<s>", "c", 0, 2, 0, 4), ("ab", "def", 1, 1, 2, 3), ("c", "</s>", 2, 0, 3, 0),
    ]


def test_unique_words_give_the_same_vocabularies(spark):
    long = "x" * 64
    words = ["<s>", "a", "b", long, long + "y", long + "yz", long + "yzz", long + "q", "c"]
    counts = spark.createDataFrame([(w, 3 + 7 * i % 5) for i, w in enumerate(words)], "word string, n long")
    for size in (2, 5, 20):
        assert sorted(vo.top_vocab(counts, size, unique=True).collect()) == sorted(vo.top_vocab(counts, size).collect())
    ranked = vo.ranked_words(counts)
    assert sorted(vo.vocab_ids(ranked, unique=True).collect()) == sorted(vo.vocab_ids(ranked).collect())
