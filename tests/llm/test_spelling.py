"""Spelling groups against a plain version."""

import re
import zlib
from collections import Counter

from arbolex.llm import spelling

DOCUMENT = "doc_id long, text string"


def plain_counts(rows, shortest=5, fewest=3, typos=97):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            key = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if typos and key % typos == 0:
                run = run[: key % len(run)] + run[key % len(run) + 1 :]
            if len(run) >= shortest:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= fewest}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, ratio=2):
    rows = {}
    for w, n in counts.items():
        near = [v for v in counts if v != w and one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= ratio * n else None
        rows[w] = (form, n, len(near), counts[form] if form else None)
    out = []
    for w, (form, n, near, form_n) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out.append((w, form, root, n, near, form_n))
    return sorted(out)


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


WORDS = {
    "color": 9, "colour": 40, "colours": 4, "colors": 4, "colox": 3, "bolor": 3, "aabbb": 20, "aabb": 30, "aabbbb": 10, "abbbb": 9,
    "bbbbb": 5, "bbbbbb": 12, "chain": 3, "chais": 6, "chaxs": 12, "chazs": 24, "chazy": 48, "chwzy": 96, "qhwzy": 192,
    "éèàùç": 4, "éèàùé": 8, "éèàù": 90, "éèàùx": 8, "vowel": 6, "towel": 6, "bowel": 3, "alone": 3, "rares": 2, "tiniest": 5,
}


def test_rare_and_awkward_texts_equal_the_plain_version(spark):
    texts = [" ".join([w.upper() if k % 2 else w for k in range(n)]) for w, n in WORDS.items()]
    texts += [None, "", "1 2 $ %", "ß÷×À", "Long" * 20_000, "vowel, towel; " * 3_000, "Überweg Überweg überweg Überweg", "color\ncolor"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "colour colour"), (7, "colour"), (7, "colour")]
    df = spark.createDataFrame(rows, DOCUMENT).selectExpr("*", "1 as word", "'x' as n", "2 as prefix")
    want = plain(plain_counts(rows))
    assert got(spelling.spelling_groups(df)) == want
    assert any(r[1] for r in want) and got(spelling.spelling_groups(df, typos=0)) == plain(plain_counts(rows, typos=0))


def test_chains_are_followed_to_their_end(spark):
    rows = [(1, " ".join(w for w, n in WORDS.items() for _ in range(n)))]
    by_word = {r[0]: r for r in got(spelling.spelling_groups(spark.createDataFrame(rows, DOCUMENT), typos=0))}
    assert by_word["chain"][2] == "qhwzy" and by_word["chais"][1] == "chazs" and by_word["chaxs"][1] == "chazs"


def test_typos_lose_the_letter_that_the_hash_points_at(spark):
    rows = [(i, "elephant " * 3) for i in range(2_000)]
    counts = {r.word: r.n for r in spelling.word_counts(spark.createDataFrame(rows, DOCUMENT)).collect()}
    assert counts == plain_counts(rows) and len(counts) > 3


def test_every_word_of_a_document_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert got(spelling.spelling_groups(docs)) == plain(plain_counts(rows))


def test_no_words(spark):
    assert spelling.spelling_groups(spark.createDataFrame([], DOCUMENT)).count() == 0
    assert spelling.spelling_groups(spark.createDataFrame([(1, None), (2, "ab cd")], DOCUMENT)).count() == 0
