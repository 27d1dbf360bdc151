"""Treebank operators over nested sentences or long token rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolex.functions.labels import N_DEPREL, ROOT
from arbolex.functions.transitions import let

COUNT_CAP = 10
# Sentences whose arcs are added up at once.
SENTENCES = 512


def quality(sents: DataFrame) -> DataFrame:
    """Unknown tags, bad heads, unknown labels, misplaced root labels and the sentences to set aside."""
    flagged = with_faults(sents)
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return flagged.agg(
        F.count(F.lit(1)).alias("n_sent"),
        count(F.col("n")).alias("n_tok"),
        *[count(F.col(c)).alias(c) for c in ("bad_tag", "bad_head", "bad_label", "bad_root")],
        count(F.col("faulty").cast("int")).alias("n_set_aside"),
    )


def with_faults(sents: DataFrame) -> DataFrame:
    """Add per-sentence fault counts and ``faulty``; such sentences cannot give move sequences."""
    number = lambda hits: F.size(hits)
    out_of_range = F.filter("heads", lambda h: (h < 0) | (h > F.col("n")))
    misplaced = F.filter(
        F.arrays_zip("heads", "deprels"), lambda w: (w["heads"] > 0) & (w["deprels"] == ROOT)
    )
    marked = (
        sents.withColumn("bad_tag", number(F.filter("upos", lambda t: t == 0)))
        .withColumn("bad_head", number(out_of_range))
        .withColumn("bad_label", number(F.filter("deprels", lambda d: d == 0)))
        .withColumn("bad_root", number(misplaced))
    )
    return marked.withColumn(
        "faulty", F.col("bad_tag") + F.col("bad_head") + F.col("bad_label") + F.col("bad_root") > 0
    )


def sound(sents: DataFrame) -> DataFrame:
    """Sentences without faults."""
    # out of a generator the arrays are computed once; the filter would compute them again for every fault, and they
    # once more behind it
    looked = ("n", "upos", "heads", "deprels")
    rows = sents.select(*[c for c in sents.columns if c not in looked], F.inline(F.array(F.struct(*looked))))
    return with_faults(rows).where(~F.col("faulty")).select(*sents.columns)


def union_corpora(**corpora: DataFrame) -> DataFrame:
    """Concatenate corpora, duplicates kept, with the name of the source in ``corpus``."""
    out = None
    for name, df in corpora.items():
        named = df.withColumn("corpus", F.lit(name))
        out = named if out is None else out.unionByName(named)
    return out


def ancestors(sents: DataFrame, steps: int = 2) -> DataFrame:
    """Head, head of the head and so on of each token, NULL past the root.

    Heads are looked up in the sentence's own array, so no self-join is needed.
    """

    def climb(heads: Column, tok: Column) -> Column:
        out, at = [], tok
        for _ in range(steps):
            at = F.nullif(F.get(heads, at - 1), F.lit(0))
            out.append(at)
        return F.array(*out)

    # bound, so that the heads are not computed again for every word
    positions = F.sequence(F.lit(1), F.col("n"))
    chains = let(F.col("heads"), lambda heads: F.transform(positions, lambda tok: climb(heads, tok)))
    return sents.select("sent_id", F.posexplode(chains).alias("pos", "chain")).select(
        "sent_id",
        (F.col("pos") + 1).alias("tok_id"),
        *[F.get("chain", F.lit(i)).alias(f"head{i + 1}") for i in range(steps)],
    )


def dependents(tokens: DataFrame, *values: str) -> DataFrame:
    """``sent_id, head, ldeps, rdeps``: left dependents ascending, right ones from the far end.

    With ``values`` each list holds structs of position and values. A group is one word's
    dependents. A word that heads itself is an error.
    """
    self_headed = F.raise_error(F.lit("a word cannot be its own head"))
    arcs = tokens.where(F.col("head") > 0).withColumn(
        "head", F.when(F.col("head") == F.col("tok_id"), self_headed).otherwise(F.col("head"))
    )
    item = F.struct("tok_id", *values) if values else F.col("tok_id")
    left = F.collect_list(F.when(F.col("tok_id") < F.col("head"), item))
    right = F.collect_list(F.when(F.col("tok_id") > F.col("head"), item))
    return arcs.groupBy("sent_id", "head").agg(
        F.sort_array(left).alias("ldeps"), F.sort_array(right, asc=False).alias("rdeps")
    )


def valency(tokens: DataFrame) -> DataFrame:
    """Left and right dependent counts of every word, as buckets ``min(count + 1, 10)``.

    Each token stands for itself and for its arc, so one aggregate does without a self-join.
    """
    arc = lambda word, left, right: F.struct(
        word.alias("tok_id"), left.cast("int").alias("nl"), right.cast("int").alias("nr")
    )
    tok, head = F.col("tok_id"), F.col("head")
    none = F.lit(0)
    parts = F.array(arc(tok, none, none), arc(F.when(head > 0, head), tok < head, tok > head))
    rows = tokens.select("sent_id", F.explode(parts).alias("p")).where(F.col("p.tok_id").isNotNull())
    counts = rows.groupBy("sent_id", F.col("p.tok_id").alias("tok_id")).agg(
        F.sum("p.nl").alias("nl"), F.sum("p.nr").alias("nr")
    )
    bucket = lambda c: F.least(F.col(c) + 1, F.lit(COUNT_CAP)).cast("int")
    return counts.select("sent_id", "tok_id", bucket("nl").alias("left_bucket"), bucket("nr").alias("right_bucket"))


def _label_rows(label_vectors: DataFrame) -> tuple[dict[int, list[float]], int]:
    """The vector of each label, and how long they are."""
    known = label_vectors.where(F.col("deprel").between(1, N_DEPREL)).limit(N_DEPREL + 1).collect()
    rows = {r["deprel"]: r["vec"] for r in known}
    if len(rows) < len(known):
        raise ValueError("a label has more than one vector")
    return rows, max(map(len, rows.values()), default=0)


def vector_sums(tokens: DataFrame, label_vectors: DataFrame) -> DataFrame:
    """Element-wise sums of the label vectors of all left and right dependents of each head.

    ``label_vectors`` (``deprel, vec``) has one row per label; rows of other numbers are left alone, so no more than one row
    per label reaches the driver, and two rows of a label are an error. Labels travel through the shuffle, vectors are
    looked up afterwards.
    """
    rows, dim = _label_rows(label_vectors)
    zero = [0.0] * dim
    table = F.array(*[F.array(*[F.lit(float(x)) for x in rows.get(i, zero)]) for i in range(1, N_DEPREL + 1)])
    lists = dependents(tokens, "deprel")

    def total(deps: str) -> Column:
        start = F.array_repeat(F.lit(0.0), dim)
        return F.aggregate(
            deps,
            start,
            lambda acc, d: F.zip_with(acc, F.get(table, d["deprel"] - 1), lambda a, b: a + b),
        )

    return lists.select("sent_id", "head", total("ldeps").alias("left_sum"), total("rdeps").alias("right_sum"))


def vector_summaries(
    sents: DataFrame, label_vectors: DataFrame, summaries: Mapping[str, Callable[[np.ndarray], np.ndarray]]
) -> DataFrame:
    """``sent_id, head`` and for each summary its value of the sums of :func:`vector_sums` (``left_<name>``, ``right_<name>``).

    From nested sentences, whose arcs are added up where they are: nothing is shuffled. A summary takes an array of one sum a
    row; a label without a number has no sum.
    """
    rows, dim = _label_rows(label_vectors)
    table = np.zeros((N_DEPREL + 1, max(1, dim)))
    table[0] = np.nan
    for label, vec in rows.items():
        table[label, : len(vec)] = vec
    names = [f"{side}_{name}" for side in ("left", "right") for name in summaries]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SENTENCES):
                part = batch.slice(start, SENTENCES)
                sizes = pc.fill_null(pc.list_value_length(part.column("heads")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                heads = pc.fill_null(part.column("heads").flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                labels = pc.fill_null(part.column("deprels").flatten(), 0).to_numpy(zero_copy_only=False)
                labels = np.where((labels >= 1) & (labels <= N_DEPREL), labels, 0)
                sent = np.repeat(np.arange(len(sizes)), sizes)
                tok = np.arange(len(sent)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
                arcs = np.flatnonzero(heads > 0)
                if (heads == tok)[arcs].any():
                    raise ValueError("a word cannot be its own head")
                # by sentence and head; the left ones ascend, the right ones descend
                left = tok < heads
                arcs = arcs[np.lexsort((np.where(left, tok, -tok)[arcs], ~left[arcs], heads[arcs], sent[arcs]))]
                fresh = np.ones(len(arcs), bool)
                fresh[1:] = (np.diff(sent[arcs]) != 0) | (np.diff(heads[arcs]) != 0)
                firsts, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
                values = []
                for side in (left[arcs], ~left[arcs]):
                    total = np.zeros((len(firsts), table.shape[1]))
                    own = group[side]
                    if len(own):
                        begin = np.flatnonzero(np.diff(own, prepend=-1))
                        total[own[begin]] = np.add.reduceat(table[labels[arcs[side]]], begin)
                    values += [pa.array(f(total)) for f in summaries.values()]
                ids = part.column("sent_id").take(pa.array(sent[arcs[firsts]]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(heads[arcs[firsts]].astype(np.int32)), *values], ["sent_id", "head", *names])

    kind = dict(sents.dtypes)["sent_id"]
    made = ", ".join(f"`{c}` double" for c in names)
    return sents.select("sent_id", "heads", "deprels").mapInArrow(run, f"sent_id {kind}, head int, {made}")


def move_total(sents: DataFrame) -> DataFrame:
    """Transitions needed for the whole treebank."""
    return sents.agg(
        F.count(F.lit(1)).alias("n_sent"), F.sum(2 * (F.col("n") - 1)).cast("bigint").alias("n_moves")
    )


def crossing(sents: DataFrame) -> DataFrame:
    """Shape of each tree: ``n_roots``, ``crosses`` and ``over_root``.

    Arcs are compared inside the sentence's array; no pairs leave the row.
    """
    arc = F.filter(
        F.transform(
            "heads", lambda h, i: F.struct(F.least(h, i + 1).alias("a"), F.greatest(h, i + 1).alias("b"))
        ),
        lambda s: s["a"] > 0,
    )
    roots = F.filter(F.transform("heads", lambda h, i: F.when(h == 0, i + 1)), lambda r: r.isNotNull())
    parts = sents.withColumn("_arcs", arc).withColumn("_roots", roots)
    cross = F.exists(
        "_arcs",
        lambda x: F.exists("_arcs", lambda y: (x["a"] < y["a"]) & (y["a"] < x["b"]) & (x["b"] < y["b"])),
    )
    over = F.exists("_arcs", lambda x: F.exists("_roots", lambda r: (x["a"] < r) & (r < x["b"])))
    return (
        parts.withColumn("n_roots", F.size("_roots"))
        .withColumn("crosses", cross)
        .withColumn("over_root", over)
        .drop("_arcs", "_roots")
    )
