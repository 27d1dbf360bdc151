"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector is the product of its three letter vectors, shifted
round by 2, 1 and 0 places, so that order counts. A document is the sum of its trigram vectors, a language the sum of
its training documents scaled to unit length; the language whose vector has the largest cosine with the document wins.

Training takes about ``bound`` documents of each language, picked by a hash of the id among the documents that are not
held out; their sums are formed in the tasks and only one vector per language and task is sent on.

Letters are folded to lower case and to 255 codes (code point modulo 255, so no two letters of a small alphabet meet);
everything else is one space between words.

Defined results. A null text, or one without letters, is ``und`` with score 0. Ties go to the first language by code
point. Rows with null id count as not held out and are not learned from; rows with null language are not learned from.
With no training row, every text is ``und``. Repeated rows get equal results. Texts are read whole. ``lang``, ``source``
and ``doc_id`` are no inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS, CODES = 512, 256
#: code points of text that are profiled together
SLICE = 1 << 18


@lru_cache(maxsize=1)
def letter_vectors() -> np.ndarray:
    """A vector for each letter code; code 0 is the space."""
    return np.random.default_rng(20).integers(0, 2, (CODES, DIMENSIONS)).astype(np.int8) * 2 - 1


@lru_cache(maxsize=1)
def code_table() -> np.ndarray:
    """Letter code of every code point, 0 for what is no letter."""
    points = np.arange(0x110000)
    letter = np.fromiter((chr(p).isalpha() for p in points), bool, len(points))
    return np.where(letter, 1 + points % (CODES - 1), 0).astype(np.int32)


def profiles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The summed trigram vectors of each text, and whether it has letters."""
    table, folded = code_table(), [" " + t.lower() + " " for t in texts]
    codes = [table[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)] for t in folded]
    of = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
    codes = np.concatenate(codes)
    keep = np.ones(len(codes), bool)  # one space between words
    keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0) | (of[1:] != of[:-1])
    codes, of = codes[keep], of[keep]
    has_letters = np.bincount(of, codes > 0, minlength=len(texts)) > 0
    inside = (of[2:] == of[:-2]) & ((codes[1:-1] > 0) | (codes[2:] > 0) & (codes[:-2] > 0))
    grams = ((codes[:-2] * CODES + codes[1:-1]) * CODES + codes[2:])[inside]
    of = of[:-2][inside]
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    if len(grams):
        seen = np.zeros(CODES**3, bool)
        seen[grams] = True
        unique = np.flatnonzero(seen)
        place = np.empty(CODES**3, np.int32)
        place[unique] = np.arange(len(unique))
        letters = letter_vectors()
        vectors = np.roll(letters, 2, 1)[unique // CODES**2] * np.roll(letters, 1, 1)[unique // CODES % CODES] * letters[unique % CODES]
        vectors, where = vectors.astype(np.float32), place[grams]
        edges = np.searchsorted(of, np.arange(len(texts) + 1))
        for lo in range(0, len(texts), 32):
            hi = min(lo + 32, len(texts))
            part = slice(edges[lo], edges[hi])
            counts = np.bincount((of[part] - lo) * len(unique) + where[part], minlength=(hi - lo) * len(unique))
            out[lo:hi] = counts.reshape(hi - lo, len(unique)).astype(np.float32) @ vectors
    return out, has_letters


def text_groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole texts of about ``SLICE`` code points; a longer text is a run of its own."""
    sizes = [len(t or "") for t in batch.column("text").to_pylist()]
    at = held = 0
    for k, size in enumerate(sizes):
        if k > at and held + size > SLICE:
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += size
    if at < len(sizes):
        yield batch.slice(at)


def held_out():
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def learn(documents: DataFrame, bound: int = 4000) -> tuple[list[str], np.ndarray]:
    """The languages in order and their unit vectors."""
    known = documents.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # a row per language
    if not counts:
        return [], np.empty((0, DIMENSIONS))
    spark = documents.sparkSession
    chances = spark.createDataFrame([(k, min(1.0, bound / n) * 2**20) for k, n in counts.items()], "lang string, cut double")
    picked = known.join(F.broadcast(chances), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("cut"))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in text_groups(batch):
                vectors, _ = profiles(part.column("text").to_pylist())
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                langs = np.array(part.column("lang").to_pylist(), object)
                for lang in set(langs):
                    sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.round(6).tolist() for v in sums.values()])], ["lang", "v"]
            )

    rows = (
        picked.select("lang", "text").mapInArrow(run, "lang string, v array<double>")
        .select("lang", F.posexplode("v").alias("at", "x"))
        .groupBy("lang", "at").agg(F.sum(F.round(F.col("x") * 1e6).cast("long")).alias("x"))  # whole numbers: any order sums alike
        .collect()  # one vector per language
    )
    names = sorted({r.lang for r in rows})
    out = np.zeros((len(names), DIMENSIONS))
    for r in rows:
        out[names.index(r.lang), r.at] = r.x
    return names, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def predict(documents: DataFrame, names: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""

    def run(batches):
        for batch in batches:
            for part in text_groups(batch):
                vectors, known = profiles([t or "" for t in part.column("text").to_pylist()])
                known &= len(names) > 0
                norms = np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)
                cosines = vectors @ prototypes.T.astype(np.float32) / norms[:, None] if len(names) else np.zeros((part.num_rows, 1))
                best = cosines.argmax(1)
                langs = [names[b] if k else "und" for b, k in zip(best, known, strict=True)]
                scores = np.where(known, np.clip(cosines.max(1), 0, 1), 0.0).astype(float)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores)],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    kind = dict(documents.dtypes)["doc_id"]
    rows = documents.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(documents: DataFrame, bound: int = 4000) -> DataFrame:
    """Learn the languages of the documents that are not held out and predict those of all."""
    names, prototypes = learn(documents, bound)
    return predict(documents, names, prototypes)
