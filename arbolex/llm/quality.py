"""Quality rules scored by an isolation forest.

Every text gets plain rule statistics; two hard rules reject it outright. The remaining judgement is an isolation
forest over shares of those statistics: trees of random splits, grown on small random samples of documents, in which
unusual rows end after short paths. What a share may reach before it counts at all (its level) and the path length
below which a document is rejected come from labelled rows: a forest over the plain shares would call a rare harmless
habit stranger than a kind of junk that an eighth of all documents have.

Defined results. A null or empty text has no words, fails the first hard rule and is not kept. Repeated rows are
judged each by itself and alike. Without any document, or with labels of one class only, the forest rejects nothing
and the hard rules decide. Columns of the input other than the id and the text are neither read nor touched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolex.llm.words import LOWER, SYMBOLS, Texts, byte_set, repeated, slices, tidy, windows
from arbolex.operators.numbering import number_rows
from arbolex.session import materialize

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = (
    "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "capital_share", "shout_per_word",
    "digit_share",
)

#: a share counts above this quantile of the labelled good documents (of few: above their maximum)
GOOD_SHARE = 0.9995

IS_SYMBOL = byte_set(SYMBOLS)
IS_CAPITAL = byte_set(bytes(range(65, 91)))
IS_LETTER = byte_set(bytes(range(97, 123)))
IS_SHOUT = byte_set(b"!?")
IS_DIGIT = byte_set(b"0123456789")


def text_statistics(texts: Texts) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Rule counts of each text and the rows of shares that the forest sees."""
    data, n = texts.data, texts.n
    of, _, hashes = texts.words()
    n_words = np.bincount(of, minlength=n)
    inside = byte_set(b" \t\n\x0b\x0c\r")[data]
    chars = texts.total(~inside & ((data & 0xC0) != 0x80))
    symbols = texts.total(IS_SYMBOL[data])

    line_of, line_hash, with_word = texts.lines()
    line_of, line_hash = line_of[with_word], line_hash[with_word]
    _, again = repeated(line_of, line_hash)
    n_lines = np.bincount(line_of, minlength=n)
    dup_lines = np.bincount(line_of[again], minlength=n)

    first, window = windows(of, hashes, 5)
    often, _ = repeated(of[first], window)
    step = np.zeros(len(of) + 1, np.int64)
    np.add.at(step, first[often], 1)
    np.add.at(step, first[often] + 5, -1)
    repeats = np.bincount(of[np.cumsum(step[:-1]) > 0], minlength=n)

    words = np.maximum(n_words, 1)
    letters = texts.total(IS_LETTER[LOWER[data]])
    shares = np.column_stack(
        [
            chars / words,
            symbols / words,
            dup_lines / np.maximum(n_lines, 1),
            repeats / words,
            texts.total(IS_CAPITAL[data]) / np.maximum(letters, 1),
            texts.total(IS_SHOUT[data]) / words,
            texts.total(IS_DIGIT[data]) / np.maximum(chars, 1),
        ]
    )
    return dict(zip(COUNTS, (n_words, chars, symbols, dup_lines, repeats), strict=True)), shares


@dataclass
class Forest:
    """Isolation trees as flat arrays: feature (-1: leaf), split value, left child (right = left + 1), path length."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    path: np.ndarray
    sample: int
    #: what each share may reach before it counts
    levels: np.ndarray
    #: scores above it are rejected
    threshold: float = 1.0

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2^(-mean path length / expected length): near 1 for rows that are isolated at once."""
        rows = np.maximum(rows - self.levels, 0)
        total = np.zeros(len(rows))
        for feature, split, left, path in zip(self.feature, self.split, self.left, self.path, strict=True):
            node = np.zeros(len(rows), np.int64)
            while True:
                inner = feature[node] >= 0
                if not inner.any():
                    break
                at = node[inner]
                node[inner] = left[at] + (rows[inner, feature[at]] >= split[at])
            total += path[node]
        return 2.0 ** -(total / max(1, len(self.feature)) / max(expected_path(self.sample), 1e-9))


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    return 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


def grow_forest(
    rows: np.ndarray, levels: np.ndarray | None = None, trees: int = 100, sample: int = 256, seed: int = 7
) -> Forest:
    """Random trees, each on ``sample`` rows drawn without repetition, split at random values of random features."""
    rng = np.random.default_rng(seed)
    levels = np.zeros(rows.shape[1]) if levels is None else levels
    rows = np.maximum(rows - levels, 0)
    sample = min(sample, len(rows))
    depth = max(1, int(np.ceil(np.log2(max(2, sample)))))
    parts = []
    for _ in range(trees if sample else 0):
        own = rows[rng.choice(len(rows), sample, replace=False)]
        feature, split, left, path = [-1], [0.0], [0], [0.0]
        todo = [(0, own, 0)]
        while todo:
            node, held, level = todo.pop()
            low, high = held.min(0), held.max(0)
            open_features = np.flatnonzero(high > low)
            if level >= depth or len(held) <= 1 or not len(open_features):
                path[node] = level + expected_path(len(held))
                continue
            f = int(rng.choice(open_features))
            at = float(rng.uniform(low[f], high[f]))
            at = at if at > low[f] else float(high[f])
            feature[node], split[node], left[node] = f, at, len(feature)
            goes_right = held[:, f] >= at
            for side in (held[~goes_right], held[goes_right]):
                todo.append((len(feature), side, level + 1))
                feature.append(-1), split.append(0.0), left.append(0), path.append(0.0)
        parts.append([np.array(x) for x in (feature, split, left, path)])
    return Forest(*([p[k] for p in parts] for k in range(4)), sample=sample, levels=levels)


def calibrate_scores(scores: np.ndarray, good: np.ndarray, lost: float = 0.005) -> float:
    """Score above which most bad labelled rows lie while at most ``lost`` of the good ones do.

    Among the cuts that lose no more good rows than that, the one with the best balanced accuracy; halfway to the
    next score, so that equal rows fall on one side. Without both classes nothing is rejected.
    """
    if good.all() or not good.any():
        return 1.0
    cuts = np.unique(scores)
    bad_above = 1 - np.searchsorted(np.sort(scores[~good]), cuts, side="right") / (~good).sum()
    good_above = 1 - np.searchsorted(np.sort(scores[good]), cuts, side="right") / good.sum()
    gain = np.where(good_above <= lost, bad_above - good_above, -1.0)
    best = int(gain.argmax())
    return float((cuts[best] + cuts[min(best + 1, len(cuts) - 1)]) / 2)


RULES_TYPE = ", ".join([*(f"{c} long" for c in COUNTS), "base_failed boolean", "shares array<double>"])
VERDICT_TYPE = RULES_TYPE + ", anomaly double, kept boolean"


def rules(text: Column, forest: Forest | None = None) -> Column:
    """Struct of the rule statistics of a text and, given a forest, its score and verdict."""

    def run(texts: pa.Array) -> pa.Array:
        names = [*COUNTS, "base_failed", "shares", *(("anomaly", "kept") if forest else ())]
        columns: dict[str, list] = {name: [] for name in names}
        for part in slices(texts):
            counts, shares = text_statistics(part)
            words = counts["n_words"]
            failed = (words < 10) | (100 * counts["n_repeat_words"] > 20 * words)
            for name in COUNTS:
                columns[name].append(counts[name].astype(np.int64))
            columns["base_failed"].append(failed)
            columns["shares"].append(shares)
            if forest:
                scores = forest.scores(shares)
                columns["anomaly"].append(scores)
                columns["kept"].append(~failed & (scores <= forest.threshold))
        arrays = []
        for name in names:
            if name == "shares":
                rows = np.concatenate([np.empty((0, len(SHARES))), *columns[name]])
                arrays.append(pa.ListArray.from_arrays(
                    pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(SHARES)), pa.array(rows.ravel())))
            else:
                kind = np.int64 if name in COUNTS else float if name == "anomaly" else bool
                arrays.append(pa.array(np.concatenate([np.empty(0, kind), *columns[name]]).astype(kind)))
        return pa.StructArray.from_arrays(arrays, names)

    # non-deterministic only in name: the planner may then not evaluate it twice
    return F.arrow_udf(tidy(run), VERDICT_TYPE if forest else RULES_TYPE).asNondeterministic()(text)


def pick(df: DataFrame, rows: int, total: int, *key: Column) -> DataFrame:
    """About ``rows`` of the ``total`` rows, by a hash of the key: the same ones in every run."""
    share = min(1.0, rows / max(1, total))
    return df if share >= 1 else df.where(F.pmod(F.xxhash64(*key), F.lit(1 << 20)) < int(share * (1 << 20)))


def measured(documents: DataFrame) -> DataFrame:
    """``doc_id`` and the rule statistics of every document, written once: they are read for the forest and for the verdicts."""
    found = documents.select("doc_id", rules(F.col("text")).alias("r"))
    return materialize(found.select("doc_id", "r.*"), "rules")


def scored(shares: Column, forest: Forest) -> Column:
    """The forest's score of written shares."""

    def run(rows: pa.Array) -> pa.Array:
        return pa.array(forest.scores(rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(SHARES))))

    return F.arrow_udf(run, "double").asNondeterministic()(shares)


def order_statistics(rows: DataFrame, rank: int, bins: int = 1024) -> list[float]:
    """The value of each share that ``rank`` others come before, over all ``rows`` (``shares``).

    Each pass counts the rows in ``bins`` equal parts of the range that is still open, and goes on inside the part that holds
    the rank, until it holds a single value: the driver sees at most ``bins`` counts a share.
    """
    values = rows.select(F.posexplode("shares").alias("at", "x"))
    ends = values.groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
    found, todo = {}, {r["at"]: (r["low"], r["high"], rank) for r in ends}
    while todo:
        found |= {at: low for at, (low, high, _) in todo.items() if low == high}
        todo = {at: part for at, part in todo.items() if at not in found}
        if not todo:
            break
        bounds = rows.sparkSession.createDataFrame([(at, *part[:2]) for at, part in todo.items()], "at int, low double, high double")
        inside = values.join(F.broadcast(bounds), "at").where(F.col("x").between(F.col("low"), F.col("high")))
        part = F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
        counts = inside.groupBy("at", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        for r in sorted(counts.collect(), key=lambda r: (r["at"], r["part"])):
            low, high, left = todo[r["at"]]
            if left is None or left >= r["n"]:
                todo[r["at"]] = (low, high, left if left is None else left - r["n"])
            else:
                todo[r["at"]] = (r["low"], r["high"], None)
                found[r["at"], "left"] = left
        todo = {at: (low, high, found.pop((at, "left"))) for at, (low, high, _) in todo.items()}
    return [found[at] for at in sorted(found)]


def threshold(rows: DataFrame, lost: float = 0.005) -> float:
    """The threshold of ``calibrate_scores`` over all ``rows`` (``score, good``), a running sum over the distinct scores."""
    n_good = F.sum(F.col("good").cast("long"))
    each = rows.groupBy("score").agg(n_good.alias("n_good"), (F.count(F.lit(1)) - n_good).alias("n_bad"))
    run = materialize(number_rows(each, ["score"], running={"good_to": "n_good", "bad_to": "n_bad"}), "cuts")
    goods, bads = run.agg(F.sum("n_good"), F.sum("n_bad")).first()
    if not goods or not bads:
        return 1.0
    bad_above, good_above = 1 - F.col("bad_to") / bads, 1 - F.col("good_to") / goods
    gain = F.when(good_above <= lost, bad_above - good_above).otherwise(-1.0)
    best = run.agg(F.max(F.struct(gain.alias("gain"), (-F.col("score")).alias("low")))["low"]).first()[0]
    after = run.where(F.col("score") > -best).agg(F.min("score")).first()[0]
    return (-best + (-best if after is None else after)) / 2


def fit_forest(
    documents: DataFrame, labels: DataFrame | None, sample_rows: int = 12_800, found: DataFrame | None = None
) -> Forest:
    """Grow the forest on about ``sample_rows`` documents and calibrate it on all labelled ones.

    The trees are grown on small random samples, as isolation trees are; ``sample_rows`` bounds what the driver holds for them,
    in rows of seven numbers picked by a hash of the id. Levels and threshold are exact over every labelled row, by counts.
    Good rows are labelled of quality 1, bad rows of quality 0; documents that fail a hard rule teach neither. ``found`` are
    the :func:`measured` documents, if they are at hand.
    """
    found = measured(documents) if found is None else found
    sample = pick(found, sample_rows, found.count(), F.col("doc_id"))
    rows = [r[0] for r in sample.where("not base_failed").select("shares").limit(2 * sample_rows).collect()]
    seen = np.array(rows, float).reshape(-1, len(SHARES))
    if labels is None:
        return grow_forest(seen)
    known = labels.select("doc_id", (F.col("quality") == 1).alias("good")).where("doc_id is not null and good is not null")
    taught = materialize(found.where("not base_failed").select("doc_id", "shares").join(known, "doc_id"), "taught")
    goods = taught.where("good")
    n = goods.count()
    forest = grow_forest(seen, np.array(order_statistics(goods, int(np.ceil(GOOD_SHARE * (n - 1))))) if n else None)
    forest.threshold = threshold(taught.select("good", scored(F.col("shares"), forest).alias("score")))
    return forest


def judged(documents: DataFrame, forest: Forest, name: str = "_rules") -> DataFrame:
    """The documents with a struct column of statistics, score and verdict; one pass, nothing is shuffled."""
    return documents.withColumn(name, rules(F.col("text"), forest))


def quality_rules(documents: DataFrame, labels: DataFrame | None, **bounds: int) -> DataFrame:
    """doc_id, rule counts, ``base_failed``, ``kept`` and the anomaly score of every document."""
    found = measured(documents)
    forest = fit_forest(documents, labels, found=found, **bounds)
    rows = found.withColumn("anomaly", scored(F.col("shares"), forest))
    kept = ~F.col("base_failed") & (F.col("anomaly") <= forest.threshold)
    return rows.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "anomaly")
