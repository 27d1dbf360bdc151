"""The operators applied to the driver's tables, one thin query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolex.llm.bpe import encode_documents
from arbolex.llm.cotrain import classify
from arbolex.llm.jaccard import jaccard_components
from arbolex.llm.langid import identify
from arbolex.llm.licenses import license_scan
from arbolex.llm.merkle import manifest
from arbolex.llm.mix import mixed
from arbolex.llm.pii import find_personal_data
from arbolex.llm.quality import quality_rules
from arbolex.llm.sql import LICENSES, MIX, TOP_K, WARC
from arbolex.llm.spelling import spelling_groups
from arbolex.llm.sql_jaccard import JACCARD
from arbolex.llm.sql_merkle import MANIFEST
from arbolex.llm.sql_spelling import SPELLING
from arbolex.llm.sql_urls import URLS
from arbolex.llm.urls import filter_urls
from arbolex.llm.vafile import top_k
from arbolex.llm.warczip import warc_round_trip


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(table(spark, folder, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"))


def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal_data(table(spark, folder, "documents"))


def op5_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc_round_trip(table(spark, folder, "pages"))


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(table(spark, folder, "documents"))


def op8_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(table(spark, folder, "documents"))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify(table(spark, folder, "documents"))


def op10_cotraining(spark: SparkSession, folder: str) -> DataFrame:
    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_spelling_groups(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_groups(table(spark, folder, "documents"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest(table(spark, folder, "documents"))


def op13_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The number that ends a page's path is the document it shows; that document's labels are the page's outcome."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    outcomes = table(spark, folder, "labels").select(F.col("doc_id").alias("item"), bad.alias("bad"))
    return filter_urls(table(spark, folder, "pages"), outcomes).drop("bad_mean", "bad_bound")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_license_scan, op3_ngram_jaccard_join, op4_personal_data, op5_exact_top_k, op6_warc,
        op7_byte_bpe, op8_source_mix, op9_language_id, op10_cotraining, op11_spelling_groups,
        op12_merkle_manifest, op13_url_filter,
    )
}
ORACLES: dict[str, str] = {
    "op2_license_scan": LICENSES, "op3_ngram_jaccard_join": JACCARD, "op5_exact_top_k": TOP_K, "op6_warc": WARC, "op8_source_mix": MIX,
    "op11_spelling_groups": SPELLING, "op12_merkle_manifest": MANIFEST, "op13_url_filter": URLS,
}
