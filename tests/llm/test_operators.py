"""Each operator against a plain version on small tables with awkward rows."""

import base64
import hashlib
import io
import re
import zipfile
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from arbolex.llm import bpe, cotrain, langid, licenses, mix, pii, quality, vafile, warczip
from arbolex.llm.components import components
from arbolex.llm.jaccard import jaccard_components, representatives

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
FOLDER = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def make(spark, texts, **more):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENT).withColumns({k: F.lit(v) for k, v in more.items()})


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


AWKWARD = [
    None, "", " \n\t\x0b ", "one", "One", "a b c d", "A B\nC\td", "a a a a a a a a a a a a", "x\ny\nx\n\nx \n",
    "# $ é%é <b> 1", "w " * 30_000, "z" * 50_000, "Ünï 日本 𝒳 #", *["the same words come here again and again in a row"] * 3,
]


# -- 1 -----------------------------------------------------------------------------------------------------------------


def rule_counts(text):
    found = words(text)
    runs = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    often = Counter(runs)
    covered = {i + k for i, r in enumerate(runs) if often[r] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(found) < 10 or 100 * len(covered) > 20 * len(found)
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), failed


def test_rule_counts_equal_the_plain_ones(spark, documents):
    texts = AWKWARD + [r.text for r in documents.limit(60).collect()]
    rows = make(spark, texts, kept="x", shares=1).transform(lambda d: quality.quality_rules(d, None)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == rule_counts(texts[r.doc_id])
        assert r.kept == (not r.base_failed)  # no labels: the forest rejects nothing


def test_forest_rejects_junk_and_keeps_clean_documents(spark, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = quality.quality_rules(documents, labels).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1
    assert quality.quality_rules(documents.limit(0), labels.limit(0)).count() == 0


def test_isolated_rows_have_short_paths():
    rng = np.random.default_rng(0)
    rows = np.vstack([rng.uniform(0, 1, (500, 3)), [[9, 9, 9]]])
    scores = quality.grow_forest(rows).scores(rows)
    assert scores.argmax() == 500
    assert quality.calibrate_scores(np.array([0.1, 0.2, 0.8, 0.9]), np.array([True, True, False, False])) == pytest.approx(0.5)


# -- 2 -----------------------------------------------------------------------------------------------------------------


def plain_licenses(text):
    units = list(dict.fromkeys([text or "", *re.split(r"\n[ \t\r]*\n", text or ""), *(text or "").split("\n")]))
    found = []
    for unit in units:
        grams = set(licenses.bigrams_of(unit))
        scored = []
        for name, template in sorted(licenses.TEMPLATES.items()):
            other = set(licenses.bigrams_of(template))
            dice = 2 * len(grams & other) / (len(grams) + len(other)) if grams else 0
            if dice >= licenses.THRESHOLD:
                scored.append((-dice, name))
        found += sorted(scored)[:1]
    return len(found), min(found)[1] if found else None, ",".join(sorted({n for _, n in found}))


def test_licenses_equal_the_plain_scan(spark):
    mit = licenses.TEMPLATES["MIT-grant"]
    texts = [
        *AWKWARD, mit, mit.upper(), mit.replace(" copy", " COPY\n"), "Foo.\n\nreleased under the mit-license!\nBar", mit[:200],
        "Released under MIT License", "Released under the MIT License. Released under the MIT License.",
        "x\n\n" + mit.replace(", ", ",\n") + "\n \nLicensed under CC BY 4.0", *licenses.TEMPLATES.values(),
    ]
    rows = licenses.license_scan(make(spark, texts, licenses="x", _units=1)).collect()
    for r in rows:
        assert (r.n_matches, r.best, r.licenses) == plain_licenses(texts[r.doc_id])
    assert sum(r.n_matches > 0 for r in rows) > 15


def test_licenses_at_the_threshold_match(spark):
    for n in range(1, 2000):
        assert licenses.size_bounds(n) == (-(-2 * n // 3), 3 * n // 2)
    texts = ["CC BY-NC 4.0", "CC BY-SA 4.0", "the BSD 3-Clause License"]  # 4 of 6 bigrams: 2 * 4 / 10
    rows = sorted(licenses.license_scan(make(spark, texts)).collect(), key=lambda r: r.doc_id)
    assert [(r.n_matches, r.best, r.dice) for r in rows] == [(1, x, 0.8) for x in ("CC-BY-NC-4.0", "CC-BY-SA-4.0", "BSD-3-Clause")]


def test_licenses_inside_lines_and_over_lines_match(spark):
    grant, header = licenses.TEMPLATES["MIT-grant"], licenses.TEMPLATES["Apache-2.0-header"]
    lines = [" ".join(header.split(" ")[k : k + 3]) for k in range(0, 40, 3)]
    wrapped = "\n * ".join([" * some words of our own", "and more", "", *lines, " ".join(f"w{k}" for k in range(60))])
    cases = [
        ("This project is small. Released under the MIT License.", 1, "MIT", 1.0, "MIT"),
        (wrapped, 1, "Apache-2.0-header", 1.0, "Apache-2.0-header"),
        ("x y z " * 40 + grant.replace("deal in", "trade in") + " a b c" * 40, 1, "MIT-grant", None, "MIT-grant"),
        ("Our code is released under the MIT License, our pictures are licensed under CC BY 4.0, all of them.", 2, "CC-BY-4.0", 1.0, "CC-BY-4.0,MIT"),
        ("Released under the MIT License.\nIt is what is called released under the MIT license here.", 2, "MIT", 1.0, "MIT"),
        ("a b c released under the MIT License d e f. g h i released under the MIT License j k l", 1, "MIT", 1.0, "MIT"),
        ("It was released under pressure.\nThe license is not named in this line of words.", 0, None, None, ""),
        ("none of the words " * 50, 0, None, None, ""),
    ]
    rows = sorted(licenses.license_scan(make(spark, [c[0] for c in cases])).collect(), key=lambda r: r.doc_id)
    for r, (_, n, best, dice, names) in zip(rows, cases, strict=True):
        assert (r.n_matches, r.best, r.licenses) == (n, best, names)
        assert r.dice == dice if dice or not n else r.dice > 0.9


# -- 3 -----------------------------------------------------------------------------------------------------------------


def plain_components(texts):
    def shingles(text):
        found = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_components_equal_all_pairs(spark, documents):
    rng = np.random.default_rng(1)
    texts = list(AWKWARD) + [r.text for r in documents.limit(50).collect()]
    base = [f"w{i}" for i in range(120)]
    for edits in rng.integers(0, 14, 60):  # a group of near copies, some of them out of reach of the others
        copy = list(base)
        for at in rng.integers(0, 120, edits):
            copy[at] = f"e{rng.integers(0, 30)}"
        texts.append(" ".join(copy))
    chain = [f"c{i}" for i in range(200)]
    texts += [" ".join(chain[k : k + 100]) for k in range(0, 100, 9)]  # each links with its neighbours only
    docs = make(spark, texts, cid="x", n=1, root="y").repartition(5)
    want = plain_components(texts)
    rows = jaccard_components(docs).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == dict(enumerate(want))
    kept = representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({w[1] for w in want})


def test_components_of_empty_and_repeated_rows(spark):
    assert jaccard_components(make(spark, [])).count() == 0
    twice = make(spark, ["a b c d e f", None]).unionByName(make(spark, ["a b c d e f", None]))
    nameless = spark.createDataFrame([(None, "a b c d e f", None, None, None)], DOCUMENT)
    rows = jaccard_components(twice.unionByName(nameless)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == Counter(
        {(0, 2, 0): 2, (1, 0, 1): 2, (None, 2, 0): 1}
    )
    assert Counter(r.doc_id for r in representatives(twice).collect()) == Counter({0: 1, 1: 2})


def test_near_copies_without_ids_are_linked(spark):
    chain, other = [f"c{i}" for i in range(120)], [f"d{i}" for i in range(100)]
    bridge = [" ".join(chain[k : k + 100]) for k in (0, 9, 18)]  # the outer two link through the middle one only
    copies = [" ".join(other), " ".join([*other[:-2], "x", "y"])]
    rows = [(1, bridge[0]), (None, bridge[1]), (2, bridge[2]), *[(None, t) for t in copies], (None, bridge[1])]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCUMENT)
    got = Counter((r.doc_id, r.component_id) for r in jaccard_components(docs).collect())
    assert got == Counter({(1, 1): 1, (2, 1): 1, (None, 1): 2, (None, None): 2})
    kept = representatives(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in kept) == [(False, 1), (True, None)]
    assert sum(r.text in copies for r in kept) == 1


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    assert {r.v: r.root for r in components(edges).collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# -- 4 -----------------------------------------------------------------------------------------------------------------

PRIVATE = [
    "mail a.b+c@ex-ample.co.uk, or a@b. a@b.c@d.e x@@y.z é@f.gh", "ip 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 9.9.9", "+1 (743) 555-3824. +123 +1+2 3456789012",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111  1111 1111 1111", "9" * 5000 + ".1.1.1", "@" * 50 + "a" * 50_000 + "@", None, "",
]


def plain_spans(text):
    """The patterns as they stand, with Python's own search."""
    out = []
    kinds = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    )
    for kind, pattern in enumerate(kinds):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            parts = [p.lstrip("0").rjust(1, "0") for p in m[0].split(".")]
            fits = (
                True,
                all(len(p) < 4 and p.isdigit() and int(p) <= 255 for p in parts),
                14 <= len(digits) <= 19 and pii.luhn(digits),
                10 <= len(digits) <= 15,
            )[kind]
            if fits:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


@pytest.mark.parametrize("text", [t for t in PRIVATE if t and len(t) < 10_000])
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_tagger_learns_and_leaves_base_spans_in_place(spark, documents):
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    tagger = pii.Tagger.fresh()
    rng = np.random.default_rng(0)
    x, y = rng.integers(1, pii.CLASSES, (3, 7)), rng.integers(0, pii.LABELS, (3, 7))
    _, grad = tagger.gradients(x, y)
    for name, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, sides = tagger.w[name][at], []
        for step in (1e-5, -1e-5):
            tagger.w[name][at] = keep + step
            sides.append(tagger.gradients(x, y)[0])
        tagger.w[name][at] = keep
        assert (sides[0] - sides[1]) / 2e-5 == pytest.approx(g[at], rel=1e-3)
    shapes = ["call +1 (743) 555-{:04d} now", "from 10.0.{}.7 on", "to u{}@mail.example.org today", "about {} of them here"]
    windows = [w for k in range(300) for w in pii.training_windows("some words before " + shapes[k % 4].format(k) + " and after it")]
    tagger = pii.train(windows)
    text = "no digits here. " * 30 + "please call +1 (743) 555-0199 now" + " and more words" * 20
    (found,) = pii.tag(tagger, [text])
    # numbers are taught with and without their plus sign, so the span may start at either
    ((a, b, kind, _),) = found
    assert kind == 3 and text[a:b].removeprefix("+") == "1 (743) 555-0199"
    assert pii.tag(tagger, ["", "plain words only"]) == [[], []]
    rows = pii.find_personal_data(make(spark, PRIVATE, spans="x", f=1)).collect()
    for r in rows:
        base = pii.base_spans(PRIVATE[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(pii.joined(base).split(",")) <= set(r.spans.split(","))
    assert pii.redacted("ab cd ef", [(0, 2, 0), (1, 4, 1), (6, 8, 3)]) == "<EMAIL>d <PHONE>"


# -- 5 -----------------------------------------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.2, 16).tolist()) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(20)]  # ties
    rows += [(500, None), (550, [None] * 16), (600, [float("nan")] * 16), (650, [float("inf")] * 16), (700, [0.5, 0.5]), (701, [0.5, -0.5]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    exact = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows
             if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = set()
    for q in (i for i in exact if i % 50 == 0):
        others = sorted((-int(exact[q] @ v), i) for i, v in exact.items() if i != q and len(v) == len(exact[q]))[:5]
        want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(others, 1)}
    got = vafile.top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert vafile.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_over_many_parts_with_copies_and_repeated_ids(spark, monkeypatch):
    for name, value in (("ROWS_BLOCK", 16), ("QUERY_BLOCK", 4), ("FILE_PART", 2), ("QUERY_PART", 2)):
        monkeypatch.setattr(vafile, name, value)
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-9, 9, 4).tolist()) for i in range(150)]
    rows += [(1_000 + i % 90, [9, 9, 9, 9]) for i in range(200)]  # a third of all rows, ids up to three times
    rows += [(50, [8, 8, 8, 8])] * 8 + [(2_000, [])] * 3 + [(2_050, [])]
    df = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    want = []
    for q, v in {(i, tuple(v)) for i, v in rows if i % 50 == 0}:
        others = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:5]
        want += [(q, rank, i, -score) for rank, (score, i) in enumerate(others, 1)]
    assert sorted(map(tuple, vafile.top_k(df, F.col("vec_id") % 50 == 0).collect())) == sorted(want)
    held = vafile.candidates(vafile.whole_numbers(df, 256).withColumn("row", F.monotonically_increasing_id()), 5)
    assert held.where("v = array(9L, 9L, 9L, 9L)").count() == 10


# -- 6 -----------------------------------------------------------------------------------------------------------------


def test_archives_are_zip_files_and_read_without_extraction():
    members = [("a.txt", b"alpha"), ("dir/b", bytes(range(256)) * 9)]
    for wide in (False, True):
        data = warczip.zip_stored(members, zip64=wide)
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == members
        found = warczip.directory(lambda at, n, d=data: d[at : at + n], len(data))
        assert {name: data[at : at + n] for name, (_, at, n) in found.items()} == dict(members)
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("x", b"data of another writer")
        z.comment = b"a comment at the end"
    data = other.getvalue()
    _, at, n = warczip.directory(lambda at, n: data[at : at + n], len(data))["x"]
    assert data[at : at + n] == b"data of another writer"


def test_payloads_that_differ_from_their_headers_are_refused():
    data = b"some payload"
    raw = warczip.record(1, "u", data, hashlib.sha1(data).hexdigest(), True, None)
    assert warczip.parse(raw) == (1, len(data), hashlib.sha1(data).hexdigest(), "response", None, data)
    for wrong in (raw.replace(data, b"same length!"), raw.replace(b"Content-Length: 12", b"Content-Length: 13")):
        assert wrong != raw
        with pytest.raises(ValueError, match="page 1"):
            warczip.parse(wrong)


def test_pages_come_back_with_revisits(spark):
    long = "é" * 600
    rows = [(1, "u", long), (5, None, long), (3, "a\r\nb", long), (2, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", "\r\n\r\n" * 400), (None, "u", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit(1))
    got = {r.page_id: r for r in warczip.warc_round_trip(df, with_payload=True).collect()}
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        data, r = (html or "").encode(), got[page_id]
        revisit = html == long and page_id != 5
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 5) if revisit else ("response", None))
        assert bytes(r.payload) == (b"" if revisit else data)
    assert warczip.warc_round_trip(df.limit(0)).count() == 0


# -- 7 -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference_encoder():
    with open(public_tokenizers.path(bpe.RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_tiktoken_library(spark, documents, reference_encoder):
    odd = ["  two  spaces ", "tab\t x", " \n", "a\x1cb \x85 c", "it's 12'34's", "<|endoftext|>", "don't  ", "日本語 テスト 👍🏽", "　x ​ y"]
    texts = [t for t in AWKWARD if not t or len(t) < 40_000] + odd + [r.text for r in documents.limit(80).collect()]
    rows = bpe.encode_documents(make(spark, texts, ids="x"), with_ids=True, with_decoded=True).collect()
    for r in rows:
        text = texts[r.doc_id] or ""
        want = reference_encoder.encode_ordinary(text)
        assert list(r.ids) == want and r.n_tokens == len(want) and bytes(r.decoded) == text.encode()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_every_entry_of_the_vocabulary_is_merged_back(reference_encoder):
    own = bpe.codec(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    tokens = bpe.read_ranks(public_tokenizers.path(bpe.RANKS))[::37]
    assert own.model.encode(["".join(own.letters[b] for b in t) for t in tokens], num_threads=1) == [[r] for r in range(0, len(tokens) * 37, 37)]


# -- 8 -----------------------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), repeats=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, rest, free = {}, float(sum(sizes.values())), set(names)
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if repeats * sizes[s] < level * weight[s] - 1e-9}
        for s in over or free:
            target[s] = float(repeats * sizes[s]) if over else level * weight[s]
        if not over:
            break
        rest -= sum(target[s] for s in over)
        free -= over
    return target


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(4)
    rows, doc = [], 0
    for source, n, top in (("a", 4, 30), ("b", 200, 60), ("é", 60, 40), ("z", 1, 5), (None, 30, 50), ("0", 3, 1)):
        for _ in range(n):
            rows.append((doc, " ".join(["w"] * int(rng.integers(0, top))) or None, None, source, None))
            doc += 1
    df = spark.createDataFrame(rows, DOCUMENT).withColumn("size", F.lit("x")).withColumn("rank", F.lit(1))
    got = mix.mixed(df, block=50).collect()
    assert len(got) == len(rows)
    source_of = {r[0]: r[3] for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want, taken = plain_targets(sizes), Counter()
    for r in got:
        source = source_of[r.doc_id]
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix.mixed(df.repartition(7), block=50).collect()))
    assert mix.mixed(df.limit(0)).count() == 0


# -- 9 -----------------------------------------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark, documents):
    rows = langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_texts_without_letters_have_no_language(spark, documents):
    awkward = make(spark, AWKWARD).withColumn("lang", F.lit("xx")).withColumn("score", F.lit(1))
    rows = {r.doc_id: r for r in langid.identify(awkward).collect()}
    assert len(rows) == len(AWKWARD)
    assert [rows[i].lang_pred for i in (0, 1, 2, 3)] == ["und", "und", "und", "xx"] and rows[0].score == 0
    assert {r.lang_pred for r in langid.identify(documents.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# -- 10 ----------------------------------------------------------------------------------------------------------------


def test_cotraining_separates_quality(spark, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = cotrain.classify(documents, labels).join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.97
    plain = cotrain.classify(make(spark, AWKWARD, score=1), labels.where("quality = 1")).collect()
    assert len(plain) == len(AWKWARD) and all(r.score == 0.5 and r.kept for r in plain)


def test_views_exchange_labels():
    rng = np.random.default_rng(5)
    truth = rng.integers(0, 2, 800)
    rows = [(np.array([t * 10 + rng.integers(0, 10)]), np.ones(1)) for t in truth]
    meta = np.zeros((800, 7 + 2 * cotrain.HASHED))
    meta[:, 0] = truth * 4 + rng.normal(0, 1, 800)
    labels = np.where(np.arange(800) < 40, truth, -1)
    views = cotrain.cotrain(cotrain.Sparse(rows), meta, labels)
    alone = cotrain.fit(cotrain.Sparse(rows), truth.astype(float), (labels >= 0).astype(float))
    z = cotrain.Sparse(rows).dot(views.text[:-1]) + views.text[-1]
    assert ((z > 0) == truth).mean() >= ((cotrain.Sparse(rows).dot(alone[:-1]) + alone[-1] > 0) == truth).mean()
    assert ((z > 0) == truth).mean() > 0.97
