"""Merkle manifest: forward and backward sweeps and the operator against a plain tree."""

import hashlib
import zlib

import pytest

from arbolex.llm import merkle

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    fields = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return h(*("-" if v is None else f"{len(v.encode())}:{v}" for v in fields))


def climb(nodes):
    """Root of a list of digests and each one's siblings by level."""
    places, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for k, at in enumerate(places):
            run, inside = runs[at // 8], at % 8
            paths[k].append((run[:inside], run[inside + 1 :]))
        nodes, places = [h(*run) for run in runs], [at // 8 for at in places]
    return nodes[0], paths


def plain(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(*row), row))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    climbed = {lang: climb([t[2] for t in sorted(trees[lang], key=lambda t: t[:3])]) for lang in langs}
    root, tops = climb([climbed[lang][0] for lang in langs])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        for (_, _, own, row), path in zip(sorted(trees[lang], key=lambda t: t[:3]), climbed[lang][1], strict=True):
            doc_id, text = row[0], row[1]
            end = own
            if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
                end = leaf(doc_id, text.translate({c: c + 32 for c in range(65, 91)}), *row[2:])
            for before, after in path + top:
                end = h(*before, end, *after)
            proof = h(*(s for before, after in path + top for s in (*before, *after)))
            out.append((doc_id, own, climbed[lang][0], root, proof, end, end == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 71, 520, 4096])
def test_sweeps_equal_the_plain_tree(n):
    leaves = [h(str(i)) for i in range(n)]
    levels = merkle.forward(leaves, merkle.height_of(n, 4))
    root, paths = climb(leaves)
    assert levels[-1] == [root]
    for at, steps in enumerate(merkle.backward(levels, [])):
        assert [tuple(s.split("|")) for s in steps] == [("".join(b), "".join(a)) for b, a in paths[at]]
        assert merkle.folded(leaves[at], steps) == root


ROWS = [
    *[(i, f"Text {i}", "en", "web", i) for i in range(70)], *[(i, "x" * i, "DE", None, None) for i in range(9)],
    (3, "lower", "fr", "web", 5), (None, None, None, None, None), (None, "Null ID", "en", None, 1), (None, "Null ID", "en", None, 1),
    (5, "", "en", "", 0), (5, "Text 5", "en", "web", 5), (5, "Text 5", "en", "web", 5), (12, "Ünï 日本 𝒳 ABC", "é", "s", 3), (15, "Long " * 50_000, "en", "s", 3),
    *[(100 + i, "A", f"l{i}", "s", 1) for i in range(11)],
]
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest_equals_the_plain_tree(spark):
    docs = spark.createDataFrame(ROWS, DOCUMENT)
    got = merkle.manifest(docs.selectExpr("*", "1 as leaf", "'x' as tree", "2 as at"))
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == plain(ROWS)


def test_small_blocks_need_rounds(spark):
    got = merkle.manifest(spark.createDataFrame(ROWS, DOCUMENT), with_steps=True, levels=1).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == plain(ROWS)
    for r in got:
        assert merkle.folded(r.leaf, r.steps) == r.root and merkle.proof_of(r.steps) == r.proof_sha256


def test_tampering_shows_only_where_it_changes_something(spark):
    rows = merkle.manifest(spark.createDataFrame(ROWS, DOCUMENT)).collect()
    assert {r.doc_id for r in rows if not r.verified} == {
        r[0] for r in ROWS if r[0] is not None and r[1] != (r[1] or "").lower() and r[1] and zlib.crc32(str(r[0]).encode()) % 3 == 0
    }


def test_one_document_and_none(spark):
    one = merkle.manifest(spark.createDataFrame(ROWS[:1], DOCUMENT)).collect()[0]
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == h()
    assert merkle.manifest(spark.createDataFrame([], DOCUMENT)).count() == 0
