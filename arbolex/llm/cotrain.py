"""A quality classifier by co-training on two views of a document.

The *content* view sees hashed words and word endings of the text; the *metadata* view sees source, language, length,
line layout and shares of character classes, and no word. Each view has its own logistic classifier. In every round
both score a pool of unlabelled documents, and the documents that one view is surest of, in the proportion of the
classes, join the training rows of the other with that label. In the end each view's score is calibrated on labelled
rows that were kept from training, and the calibrated views are added as evidence from independent sources.

Training takes bounded samples (``labelled`` and ``pool`` rows, picked by a hash of the id); the scoring is one pass
over all documents without a shuffle.

Defined results. A null or empty text has an empty content view and is scored by its metadata, null source or language
being values of their own. Repeated rows score alike. Without labelled rows of both classes every score is 0.5 and
everything is kept. Other columns are neither read nor touched.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolex.llm.quality import IS_CAPITAL, IS_DIGIT, IS_LETTER, IS_SYMBOL, calibrate_scores, pick
from arbolex.llm.words import IS_WORD, LOWER, Texts, mix, slices

WORDS, ENDINGS, HASHED = 1 << 13, 1 << 11, 16
#: how sure a view must be, and the share of the pool that it may label in a round
SURE, SHARE, ROUNDS = 0.9, 0.1, 4


def content(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, weight) entries of the content view: shares of hashed words and of their last two bytes."""
    of, sizes, hashes = texts.words(lower=True)
    data = LOWER[texts.data][IS_WORD[texts.data]]
    last = np.cumsum(sizes) - 1
    before = np.where(sizes > 1, data[np.maximum(last - 1, 0)], 0) if len(data) else np.empty(0, np.uint8)
    endings = mix(before.astype(np.uint64) * np.uint64(256) + data[last].astype(np.uint64)) if len(data) else hashes
    words = (hashes >> np.uint64(51)).astype(np.int64)
    buckets = np.concatenate([words, WORDS + (endings >> np.uint64(53)).astype(np.int64)])
    owner = np.concatenate([of, of])
    pairs, counts = np.unique(owner * (WORDS + ENDINGS) + buckets, return_counts=True)
    owner, buckets = np.divmod(pairs, WORDS + ENDINGS)
    total = np.maximum(np.bincount(of, minlength=texts.n), 1)
    return owner, buckets, np.sqrt(counts / total[owner])


def metadata(texts: Texts, sources: list, langs: list) -> np.ndarray:
    """Rows of the metadata view."""
    data = texts.data
    size = np.diff(texts.bounds)
    lines = texts.total(data == 10) + 1
    solid = np.maximum(texts.total(IS_WORD[data]), 1)
    letters = np.maximum(texts.total(IS_LETTER[LOWER[data]]), 1)
    rows = np.zeros((texts.n, 7 + 2 * HASHED))
    rows[:, 0] = np.log1p(size)
    rows[:, 1] = np.log(lines)
    rows[:, 2] = np.log1p(size / lines)
    rows[:, 3] = np.sqrt(texts.total(IS_CAPITAL[data]) / letters)
    rows[:, 4] = np.sqrt(texts.total(IS_DIGIT[data]) / solid)
    rows[:, 5] = np.sqrt(texts.total(IS_SYMBOL[data]) / solid)
    rows[:, 6] = np.sqrt(texts.total(data >= 128) / solid)
    for base, values in ((7, sources), (7 + HASHED, langs)):
        at = [zlib.crc32(repr(v).encode()) % HASHED for v in values]
        rows[np.arange(texts.n), base + np.array(at, np.int64)] = 0.3
    return rows


def logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Sparse:
    """Rows of (bucket, weight) entries."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        self.bucket = np.concatenate([np.empty(0, np.int64), *(r[0] for r in rows)]).astype(np.int64)
        self.weight = np.concatenate([np.empty(0), *(r[1] for r in rows)])
        self.n, self.width = len(rows), WORDS + ENDINGS

    def dot(self, w):
        return np.bincount(self.owner, self.weight * w[self.bucket], self.n)

    def back(self, g):
        return np.bincount(self.bucket, self.weight * g[self.owner], self.width)


class Dense:
    def __init__(self, rows: np.ndarray):
        self.rows, self.width = rows, rows.shape[1]

    def dot(self, w):
        return self.rows @ w

    def back(self, g):
        return self.rows.T @ g


def fit(x, y: np.ndarray, mass: np.ndarray, steps: int = 120) -> np.ndarray:
    """Weights (the last is the bias) of a logistic classifier on the rows of non-zero ``mass``, by Adam."""
    w = np.zeros(x.width + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    mass = mass / max(mass.sum(), 1e-9)
    for step in range(1, steps + 1):
        g = (logistic(x.dot(w[:-1]) + w[-1]) - y) * mass
        grad = np.append(x.back(g) + 1e-5 * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def platt(z: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset that turn a score into log-odds, by Newton steps with a little shrinkage."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = logistic(a * z + b)
        r, s = p - y, p * (1 - p) + 1e-6
        g = np.array([(r * z).sum() + 0.01 * (a - 1), r.sum()])
        h = np.array([[(s * z * z).sum() + 0.01, (s * z).sum()], [(s * z).sum(), s.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(a), float(b)


@dataclass
class Views:
    """Both classifiers with their calibration; scores above 1 - ``threshold`` of badness are rejected."""

    text: np.ndarray | None = None
    meta: np.ndarray | None = None
    mean: np.ndarray = field(default_factory=lambda: np.zeros(7 + 2 * HASHED))
    scale: np.ndarray = field(default_factory=lambda: np.ones(7 + 2 * HASHED))
    text_scale: tuple[float, float] = (1.0, 0.0)
    meta_scale: tuple[float, float] = (1.0, 0.0)
    prior: float = 0.0
    threshold: float = 1.0

    def odds(self, z_text: np.ndarray, z_meta: np.ndarray) -> np.ndarray:
        """Log-odds of both views together; the prior is in each of them and counts once."""
        one = self.text_scale[0] * z_text + self.text_scale[1]
        two = self.meta_scale[0] * z_meta + self.meta_scale[1]
        return one + two - self.prior


def cotrain(x_text: Sparse, meta: np.ndarray, labels: np.ndarray) -> Views:
    """``labels`` holds 1, 0 or -1 (unlabelled). A fifth of the labelled rows is kept for the calibration."""
    known = np.flatnonzero(labels >= 0)
    if not (labels == 0).any() or not (labels == 1).any():
        return Views()
    views = Views(mean=meta.mean(0), scale=meta.std(0) + 1e-6)
    x_meta = Dense((meta - views.mean) / views.scale)
    kept = known[np.arange(len(known)) % 5 == 0]
    own = np.where(labels >= 0, labels, 0).astype(float)
    teach = [np.where(labels >= 0, 1.0, 0.0), np.where(labels >= 0, 1.0, 0.0)]
    for mass in teach:
        mass[kept] = 0
    answers = [own.copy(), own.copy()]
    pool = labels < 0
    good_share = (labels[known] == 1).mean()
    for turn in range(ROUNDS + 1):
        views.text, views.meta = fit(x_text, answers[0], teach[0]), fit(x_meta, answers[1], teach[1])
        if turn == ROUNDS:
            break
        for view, (x, w) in enumerate(((x_text, views.text), (x_meta, views.meta))):
            other, p = 1 - view, logistic(x.dot(w[:-1]) + w[-1])
            free = np.flatnonzero(pool & (teach[other] == 0))
            room = SHARE * pool.sum()
            for sure, label, most in ((p[free], 1.0, good_share * room), (1 - p[free], 0.0, (1 - good_share) * room)):
                best = free[np.argsort(-sure, kind="stable")[: int(most) + 1]]
                best = best[np.where(label == 1.0, p[best], 1 - p[best]) >= SURE]
                answers[other][best], teach[other][best] = label, 0.5
    y = labels[kept].astype(float)
    if 0 < y.sum() < len(y):
        z = [x.dot(w[:-1]) + w[-1] for x, w in ((x_text, views.text), (x_meta, views.meta))]
        views.text_scale, views.meta_scale = platt(z[0][kept], y), platt(z[1][kept], y)
        views.prior = float(np.log(y.mean() / (1 - y.mean())))
        bad = 1 - logistic(views.odds(z[0][kept], z[1][kept]))
        views.threshold = calibrate_scores(bad, y == 1)
    return views


ROW_TYPE = "buckets array<int>, weights array<float>, meta array<double>"


def features(text: Column, source: Column, lang: Column) -> Column:
    """Struct of both views of a document, for the training rows."""

    def run(texts: pa.Array, sources: pa.Array, langs: pa.Array) -> pa.Array:
        sources, langs, rows, at = sources.to_pylist(), langs.to_pylist(), [], 0
        for part in slices(texts):
            owner, bucket, weight = content(part)
            cuts = np.searchsorted(owner, np.arange(1, part.n))
            meta = metadata(part, sources[at : at + part.n], langs[at : at + part.n])
            at += part.n
            rows += [{"buckets": b, "weights": w, "meta": m} for b, w, m in zip(
                np.split(bucket.astype(np.int32), cuts), np.split(weight.astype(np.float32), cuts), meta, strict=True)]
        kind = pa.struct([("buckets", pa.list_(pa.int32())), ("weights", pa.list_(pa.float32())), ("meta", pa.list_(pa.float64()))])
        return pa.array(rows, kind)

    return F.arrow_udf(run, ROW_TYPE).asNondeterministic()(text, source, lang)


def scored(text: Column, source: Column, lang: Column, views: Views) -> Column:
    """Struct of text_score, meta_score, score (chance of good quality) and kept."""

    def run(texts: pa.Array, sources: pa.Array, langs: pa.Array) -> pa.Array:
        sources, langs, at = sources.to_pylist(), langs.to_pylist(), 0
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for part in slices(texts):
            meta = (metadata(part, sources[at : at + part.n], langs[at : at + part.n]) - views.mean) / views.scale
            at += part.n
            if views.text is None:
                scores = [np.full(part.n, 0.5)] * 3
            else:
                owner, bucket, weight = content(part)
                z_text = np.bincount(owner, weight * views.text[bucket], part.n) + views.text[-1]
                z_meta = meta @ views.meta[:-1] + views.meta[-1]
                scores = [logistic(views.text_scale[0] * z_text + views.text_scale[1]),
                          logistic(views.meta_scale[0] * z_meta + views.meta_scale[1]), logistic(views.odds(z_text, z_meta))]
            for column, values in zip(columns, [*scores, 1 - scores[2] <= views.threshold], strict=True):
                column.append(values)
        arrays = [np.concatenate([np.empty(0, kind), *c]) for c, kind in zip(columns, (float, float, float, bool), strict=True)]
        return pa.StructArray.from_arrays([pa.array(a) for a in arrays], ["text_score", "meta_score", "score", "kept"])

    kind = "text_score double, meta_score double, score double, kept boolean"
    return F.arrow_udf(run, kind).asNondeterministic()(text, source, lang)


def fit_views(documents: DataFrame, labels: DataFrame, labelled: int = 4000, pool: int = 4000) -> Views:
    """Co-train on about ``labelled`` labelled and ``pool`` unlabelled documents; the driver holds at most twice that."""
    docs = documents.select("doc_id", "text", "source", "lang")
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)")
    key = F.col("doc_id")
    chosen = pick(known, labelled, known.count(), key, F.lit("views")).limit(2 * labelled)
    taught = docs.join(F.broadcast(chosen), "doc_id").limit(2 * labelled)  # bounded by ``labelled`` small rows
    free = pick(docs.where("doc_id is not null"), pool, docs.count(), key, F.lit("pool")).limit(2 * pool)
    free = free.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti").withColumn("quality", F.lit(-1))
    rows = (
        taught.unionByName(free)
        .select("doc_id", "quality", features(F.col("text"), F.col("source"), F.col("lang")).alias("f"))
        .select("doc_id", "quality", "f.*")
        .collect()
    )
    rows.sort(key=lambda r: (r.doc_id, r.quality, r.meta))
    sparse = Sparse([(np.array(r.buckets, np.int64), np.array(r.weights)) for r in rows])
    meta = np.array([r.meta for r in rows]).reshape(-1, 7 + 2 * HASHED)
    return cotrain(sparse, meta, np.array([r.quality for r in rows], np.int64))


def classify(documents: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, text_score, meta_score, score and kept of every document."""
    views = fit_views(documents, labels, **bounds)
    made = scored(F.col("text"), F.col("source"), F.col("lang"), views)
    return documents.select("doc_id", made.alias("s")).select("doc_id", "s.text_score", "s.meta_score", "s.score", "s.kept")
