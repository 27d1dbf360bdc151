"""The tag and label tables of the treebank format, and their DataFrame forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The 17 universal part-of-speech tags, ids 1 to 17 in this order.
UPOS = [
    "ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON", "PROPN",
    "PUNCT", "SCONJ", "SYM", "VERB", "X",
]

# The 37 universal dependency relations, ids 1 to 37 in this order (root first).
DEPREL = [
    "root", "acl", "advcl", "advmod", "amod", "appos", "aux", "case", "cc", "ccomp", "clf", "compound",
    "conj", "cop", "csubj", "dep", "det", "discourse", "dislocated", "expl", "fixed", "flat", "goeswith",
    "iobj", "list", "mark", "nmod", "nsubj", "nummod", "obj", "obl", "orphan", "parataxis", "punct",
    "reparandum", "vocative", "xcomp",
]

N_UPOS, N_DEPREL = len(UPOS), len(DEPREL)
ROOT = 1


def upos_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(UPOS, 1)], "tag string, id int")


def deprel_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(DEPREL, 1)], "label string, id int")
