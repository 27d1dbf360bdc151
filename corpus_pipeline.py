"""A training corpus from raw documents: filter, deduplicate, redact, mix, encode.

Each stage takes (spark, documents, folder of the tables) and returns a DataFrame; all but the last return documents with
the columns they got. A stage's result is written to the shared folder and read again before the next one.

Defined results: null and empty texts fail the quality rules; every stage accepts an empty table, repeated rows, null
columns and further columns, whatever their names, and carries those columns along unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolex.llm.bpe import encode_documents
from arbolex.llm.jaccard import representatives
from arbolex.llm.mix import mixed
from arbolex.llm.pii import fit_tagger, personal_data
from arbolex.llm.quality import fit_forest, judged
from arbolex.session import materialize


def unused(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the hard rules and the isolation forest."""
    forest = fit_forest(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    name = unused(docs, "_rules")
    return judged(docs, forest, name).where(F.col(f"{name}.kept")).select(*columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of linked ones: that of the smallest id. Documents without words are in no group."""
    return representatives(docs)


def redaction(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Personal data replaced by the name of its kind; ``n_chars``, if there, follows the new text."""
    name = unused(docs, "_found")
    found = docs.withColumn(name, personal_data(F.col("text"), fit_tagger(docs), redact=True))
    clean, changed = F.col(f"{name}.clean"), F.col(f"{name}.spans") != ""
    replaced = {"text": clean, "n_chars": F.when(changed, F.length(clean).cast("long")).otherwise(F.col("`n_chars`")) if "n_chars" in docs.columns else None}
    return found.select(*[replaced[c].alias(c) if c in replaced else F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document as often as the mix takes it, a part of half or more counting as whole. Documents without words go.

    Rows are numbered and written once, so each has its own share whatever its id."""
    rows = docs.select(F.struct(*columns(docs)).alias("_doc"))
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    shares = (
        mixed(rows.select("_doc.doc_id", "_doc.source", "_doc.text", "_row"), row="_row")
        .where("size > 0")
        .select("_row", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("_copies"))
        .where("_copies > 0")
    )
    copies = rows.join(shares, "_row").select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return copies.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


def encoding(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of every document."""
    return encode_documents(docs, with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("n-gram jaccard join", near_duplicates),
    ("personal data", redaction),
    ("source mix", mix),
    ("byte-level bpe", encoding),
]

#: The forest, the tagger and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
