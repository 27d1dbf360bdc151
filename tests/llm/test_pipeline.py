"""The pipeline stage by stage, and the operators' queries next to SQL."""

import re

import pyspark.sql.functions as F
import pytest

import corpus_pipeline
from arbolex.llm import pii
from arbolex.llm.jaccard import jaccard_components
from arbolex.llm.mix import mixed

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark, documents):
    """Documents with nulls, repeated rows and columns whose names the stages use themselves."""
    more = documents.limit(3).unionByName(
        spark.createDataFrame([(None, "null id " * 8, None, None, None), (9_000_001, None, None, None, None), (9_000_002, "", "x", "y", 0)], documents.schema)
    )
    clash = {c: F.lit("mine") for c in ("kept", "_rules", "_found", "size", "_size", "cid", "root", "text_hash")}
    return documents.unionByName(more).withColumns(clash)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_the_columns(spark, odd, name, stage):
    out = stage(spark, odd, FOLDER)
    assert out.dtypes == odd.dtypes
    assert out.where("kept <> 'mine'").count() == 0 and out.count() > 0
    assert stage(spark, odd.limit(0), FOLDER).count() == 0


def test_one_document_of_each_group_stays(spark, documents):
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, documents, FOLDER).collect())
    assert kept == sorted({r.component_id for r in jaccard_components(documents).collect()})


def test_redaction_leaves_nothing_that_the_patterns_find(spark, documents):
    before = {r.doc_id: r.text for r in documents.collect()}
    for r in corpus_pipeline.redaction(spark, documents, FOLDER).collect():
        if not pii.base_spans(before[r.doc_id]) and r.text == before[r.doc_id]:
            continue
        assert pii.base_spans(r.text) == [] and re.search("<(EMAIL|IP|CARD|PHONE)>", r.text) and r.n_chars == len(r.text)


def test_mix_repeats_documents(spark, documents):
    want = {r.doc_id: (2 * r.taken + r.size) // (2 * r.size) for r in mixed(documents).collect() if r.size}
    got = {r.doc_id: r["count"] for r in corpus_pipeline.mix(spark, documents, FOLDER).groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_rows_without_id_and_of_one_id_each_have_their_share(spark, documents):
    null = [(None, "some words here " * (1 + i % 7), "x", "a", None) for i in range(1_000)]
    same = [(7, "again " * (1 + i % 5), "x", "b", None) for i in range(1_000)]
    rest = [(i, "w " * 50, "x", "c", None) for i in range(40)]
    docs = spark.createDataFrame(null + same + rest, documents.schema)
    targets = {r.source: (r.target, r.words) for r in mixed(docs.withColumn("n", F.monotonically_increasing_id()), row="n")
               .join(docs.withColumn("n", F.monotonically_increasing_id()).select("n", "source"), "n")
               .groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("words")).collect()}
    assert all(abs(words - target) <= 1 for target, words in targets.values())
    out = corpus_pipeline.mix(spark, docs, FOLDER)
    words = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " +"))).alias("n")).collect()}
    for source, (target, _) in targets.items():
        assert abs(words[source] - target) < 0.03 * target
    # nulls are spread: no bucket holds more than its share
    sizes = docs.where("doc_id is null").select("doc_id", "source", "text")
    assert mixed(sizes).count() == 1_000


def test_run_applies_all_stages(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert out.where("size(ids) <> n_tokens").count() == 0 and out.count() > 50
