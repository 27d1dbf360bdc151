"""N-gram Jaccard join by vertical partitioning.

A document's set is its distinct word shingles. All shingles stand in one global order, which is cut into fragments;
each fragment counts on its own how much of a pair of sets (or of one set and all others) overlaps inside it, and the
partial counts are summed per pair.

1. *Screen.* Two sets that link share at least ``slack(n)`` shingles among the first ``n // 4 + slack(n)`` of each in
   the global order. Those first shingles go to fragments, which report how many of a set's shingles some other set
   has too; sets below their bound link with nothing and drop out. Sets travel in chunks of many documents, so a
   shingle that very many documents share is one entry per chunk.
2. *Segments.* The remaining distinct sets count all their shingles the same way. The order now is by frequency, rare
   first; shingles of one set only drop out, the rest becomes one segment per (set, fragment).
3. *Join.* Sets whose prefixes share enough shingles are candidates. A candidate pair's overlap is the sum of its
   partial overlaps per fragment, an exact count. A large group of near copies has about the square of its size in
   pairs, so each round compares a set with one leader of the buckets it is in, the set with the most common shingles
   first; what is still apart after the rounds is compared in full, all candidate pairs of different components whose
   sketches leave a link possible. So every set ends in its right component.

Defined results. A null or empty text has an empty set and is linked with nothing. Repeated rows and texts of equal
sets are one class, so linked. A row without id takes part; its class goes by the smallest id that is there, or null.
The ids of one row may repeat. Columns other than the id and the text are neither read nor touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolex.llm.components import components
from arbolex.llm.words import Texts, give_back, mix, slices, tidy, weights, windows
from arbolex.session import materialize

#: shingles in a chunk of sets, and bytes of text for each fragment of the order
CHUNK, FRAGMENT_BYTES = 1 << 19, 24 << 20
#: rounds of comparing with leaders only
ROUNDS = 2
MANY = np.uint32(0xFFFFFFFF)
#: 64-bit words of a set's sketch
SKETCH = 16


def shingle_sets(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(size of each text's set, the sets' shingle hashes one after the other, ascending in each)."""
    of, _, hashes = texts.words(lower=True)
    counts = np.bincount(of, minlength=texts.n)
    first, grams = windows(of, hashes, width)
    owner = of[first]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        at = np.cumsum(counts) - counts
        inner = np.repeat(counts < width, counts)
        place = np.arange(len(of)) - at[of]
        sums = np.zeros(texts.n, np.uint64)
        np.add.at(sums, of[inner], hashes[inner] * weights(width)[place[inner]])
        grams = np.concatenate([grams, mix(sums[short] + counts[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return np.bincount(owner[new], minlength=texts.n), grams[new]


def set_keys(sizes: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """A 128-bit key of each set, as two 64-bit numbers; zero for an empty one."""
    out = np.zeros((len(sizes), 2), np.uint64)
    full = sizes > 0
    if full.any():
        first = (np.cumsum(sizes) - sizes)[full]
        for k, salt in enumerate(weights(2)):
            out[full, k] = mix(np.add.reduceat(mix(grams ^ salt), first) + sizes[full].astype(np.uint64))
    return out


def slack(n):
    return np.maximum(1, n // 10)


def sketch(grams: np.ndarray) -> np.ndarray:
    """Bit ``i`` is the parity of the shingles that hash to it: two sketches differ in at most as many bits as the sets
    do in shingles."""
    bits = SKETCH * 64
    odd = np.bincount((mix(grams) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def binary(keys: np.ndarray) -> pa.Array:
    """16-byte values from rows of two 64-bit numbers."""
    data = np.ascontiguousarray(keys)
    bounds = np.arange(len(keys) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(bounds), pa.py_buffer(data)])


def numbers(cell, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(cell.as_py() or b"", kind)


def chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, pa.Table, np.ndarray, np.ndarray]]:
    """(chunk id, its rows without the text, set sizes, shingles); ids differ between tasks."""
    base, rows, sizes, grams, held = TaskContext.get().partitionId() << 32, [], [], [], 0
    for batch in batches:
        rest, at = batch.drop_columns("text"), 0
        for part in slices(batch.column("text")):
            size, gram = shingle_sets(part, width)
            rows.append(rest.slice(at, part.n)), sizes.append(size), grams.append(gram)
            at, held = at + part.n, held + len(gram) + part.n
            if held >= CHUNK:
                yield base, pa.Table.from_batches(rows), np.concatenate(sizes), np.concatenate(grams)
                base, rows, sizes, grams, held = base + 1, [], [], [], 0
    if rows:
        yield base, pa.Table.from_batches(rows), np.concatenate(sizes), np.concatenate(grams)
    rows, sizes, grams = [], [], []
    give_back()


def by_fragment(fragment: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(fragment, its part of each column) for every fragment that occurs."""
    if not len(fragment):
        return
    order = np.argsort(fragment, kind="stable")
    found, first = np.unique(fragment[order], return_index=True)
    for f, lo, hi in zip(found, first, [*first[1:], len(order)], strict=True):
        yield (int(f), *(c[order[lo:hi]] for c in columns))


SCREEN_ROW = "frag int, chunk long, tokens binary, owners binary, head binary"


def screened(documents: DataFrame, fragments: int, width: int) -> DataFrame:
    """(doc_id, text_hash, n, cid, shared) of every row: ``shared`` is how many of the first shingles others have."""

    def send(batches):
        for chunk, rows, sizes, grams in chunks(batches, width):
            keys = set_keys(sizes, grams)
            _, one, klass = np.unique(keys, axis=0, return_index=True, return_inverse=True)
            klass = klass.ravel()
            place = np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = place < np.repeat(sizes // 4 + slack(sizes), sizes)
            first &= np.repeat(np.isin(np.arange(len(sizes)), one), sizes)  # equal sets of a chunk count once
            tokens, owners = grams[first], np.repeat(klass, sizes)[first].astype(np.uint32)
            order = np.argsort(tokens, kind="stable")
            tokens, owners = tokens[order], owners[order]
            same = tokens[1:] == tokens[:-1]
            many = np.zeros(len(tokens), bool)
            many[1:] |= same
            many[:-1] |= same
            local = np.bincount(owners[many], minlength=len(one))
            keep = np.ones(len(tokens), bool)
            keep[1:] = ~same  # a shingle of several sets of the chunk is known to be shared: one entry says so
            tokens, owners = tokens[keep], np.where(many[keep], MANY, owners[keep])
            ids = rows.column("doc_id")
            head = [
                ids.is_valid().to_numpy().astype(np.int64), ids.fill_null(0).to_numpy(),
                rows.column("text_hash").to_numpy(), sizes, klass, local[klass], keys.ravel().view(np.int64),
            ]
            out = [(-1 - chunk % fragments, chunk, None, None, np.concatenate(head).astype(np.int64).tobytes())]
            out += [(f, chunk, t.tobytes(), o.tobytes(), None) for f, t, o in by_fragment(tokens % np.uint64(fragments), tokens, owners)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                ["frag", "chunk", "tokens", "owners", "head"],
            )

    def count(table: pa.Table) -> pa.Table:
        if table.column("frag")[0].as_py() < 0:
            return pa.table({"chunk": table.column("chunk"), "counts": pa.nulls(len(table), pa.binary()), "head": table.column("head")})
        tokens = [numbers(c) for c in table.column("tokens")]
        owners = np.concatenate([numbers(c, np.uint32) for c in table.column("owners")])
        row = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        tokens = np.concatenate(tokens)
        order = np.argsort(tokens)
        same = tokens[order][1:] == tokens[order][:-1]
        shared = np.zeros(len(tokens), bool)
        shared[order[1:]] |= same
        shared[order[:-1]] |= same
        hit = np.flatnonzero(shared & (owners != MANY))
        counts = [np.concatenate(np.unique(owners[hit[lo:hi]], return_counts=True)).astype(np.uint32).tobytes()
                  for lo, hi in zip(*(np.searchsorted(row[hit], np.arange(len(table)) + k) for k in (0, 1)), strict=True)]
        return pa.table({"chunk": table.column("chunk"), "counts": pa.array(counts, pa.binary()), "head": pa.nulls(len(table), pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        head = next(numbers(h, np.int64) for h in table.column("head") if h.is_valid)
        n = len(head) // 8
        known, ids, text_hash, sizes, klass, shared = head[: 6 * n].reshape(6, n)
        more = np.zeros(int(klass.max(initial=0)) + 1, np.int64)
        for cell in table.column("counts"):
            pairs = numbers(cell, np.uint32)
            more[pairs[: len(pairs) // 2]] += pairs[len(pairs) // 2 :]
        keys = binary(head[6 * n :].reshape(n, 2))
        empty = pa.array(sizes == 0)
        return pa.table({
            "doc_id": pa.array(ids, mask=known == 0), "text_hash": text_hash, "n": sizes, "shared": shared + more[klass],
            "cid": pa.compute.if_else(empty, pa.scalar(None, pa.binary()), keys),
        })

    rows = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    counted = rows.mapInArrow(send, SCREEN_ROW).groupBy("frag").applyInArrow(tidy(count), "chunk long, counts binary, head binary")
    return counted.groupBy("chunk").applyInArrow(tidy(gather), "doc_id long, text_hash long, n long, shared long, cid binary")


CHUNK_ROW = "chunk long, cids binary, sizes binary, tokens binary"
SEGMENT_ROW = "cid binary, n long, common double, frag int, tokens array<long>, alone long, sketch array<long>"
PREFIX = -1


def segments(documents: DataFrame, chosen: DataFrame, fragments: int, width: int) -> DataFrame:
    """(cid, n, frag, tokens) of the chosen sets that share enough: segments of the frequency order, and prefixes.

    A prefix row also has the number of shingles that no other set has (``alone``) and the sketch of the rest."""

    def pack(batches):
        for chunk, rows, sizes, grams in chunks(batches, width):
            keys = set_keys(sizes, grams)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk]), *(pa.array([x.tobytes()], pa.binary()) for x in (keys, sizes.astype(np.int64), grams))],
                ["chunk", "cids", "sizes", "tokens"],
            )

    def send(batches):
        for batch in batches:
            for chunk, cell in zip(batch.column("chunk"), batch.column("tokens"), strict=True):
                tokens, counts = np.unique(numbers(cell), return_counts=True)
                out = [(f, chunk.as_py(), t.tobytes(), c.tobytes())
                       for f, t, c in by_fragment(tokens % np.uint64(fragments), tokens, counts.astype(np.uint32))]
                columns = list(zip(*out, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                    ["frag", "chunk", "tokens", "counts"],
                )

    def count(table: pa.Table) -> pa.Table:
        tokens = [numbers(c) for c in table.column("tokens")]
        ends = np.cumsum([len(t) for t in tokens])
        _, which = np.unique(np.concatenate(tokens), return_inverse=True)
        total = np.bincount(which, np.concatenate([numbers(c, np.uint32) for c in table.column("counts")]))
        parts = np.split(total[which].astype(np.uint32), ends[:-1])
        return pa.table({"chunk": table.column("chunk"), "frag": table.column("frag"), "df": pa.array([p.tobytes() for p in parts], pa.binary())})

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        cids, ns, commons, frags, lists, alones, sketches = [], [], [], [], [], [], []
        df_of = {f.as_py(): numbers(c, np.uint32) for f, c in zip(right.column("frag"), right.column("df"), strict=True)}
        for row in range(len(left)):
            grams = numbers(left.column("tokens")[row])
            sizes = numbers(left.column("sizes")[row], np.int64)
            keys = numbers(left.column("cids")[row]).reshape(-1, 2)
            unique, which = np.unique(grams, return_inverse=True)
            df = np.zeros(len(unique), np.uint32)
            for f, at in by_fragment(unique % np.uint64(fragments), np.arange(len(unique))):
                df[at] = df_of[f]
            df, at = df[which], 0
            for key, n in zip(keys, sizes, strict=True):
                n, own, often = int(n), grams[at : at + n], df[at : at + n]
                at += n
                shared = often > 1
                needed = -(-75 * n // 100)
                if shared.sum() < needed:
                    continue
                common = float(np.log2(often).mean())
                own, level = own[shared], np.frexp(often[shared].astype(float))[1] // 2
                order = np.lexsort((own, level))
                own, level = own[order], level[order]
                alone = n - len(own)  # shingles of no other set come first in the order and match nothing
                piece = level.astype(np.int64) * 2 + (own >> np.uint64(63)).astype(np.int64)
                starts = np.unique(piece, return_index=True)
                cuts = [(PREFIX, own[: max(0, n - needed + 1 - alone)])]
                cuts += [(int(f), part) for f, part in zip(starts[0], np.split(own, starts[1][1:]), strict=True)]
                for f, part in cuts:
                    cids.append(key.tobytes()), ns.append(n), commons.append(common), frags.append(f), lists.append(part.view(np.int64))
                    alones.append(alone if f == PREFIX else None), sketches.append(sketch(own) if f == PREFIX else None)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        values = np.concatenate([np.empty(0, np.int64), *lists])
        return pa.table({"cid": pa.array(cids, pa.binary()), "n": pa.array(ns, pa.int64()),
                         "common": pa.array(commons, pa.float64()), "frag": pa.array(frags, pa.int32()),
                         "tokens": pa.ListArray.from_arrays(pa.array(bounds), pa.array(values)),
                         "alone": pa.array(alones, pa.int64()), "sketch": pa.array(sketches, pa.list_(pa.int64()))})

    rows = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    picked = chosen.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    texts = (
        # rows without id are told apart by their text
        rows.join(picked, rows["doc_id"].eqNullSafe(picked["_id"]) & (rows["text_hash"] == picked["_hash"]), "left_semi")
        .dropDuplicates(["doc_id", "text_hash"])
    )
    packed = materialize(texts.mapInArrow(pack, CHUNK_ROW), "sets")
    counted = packed.select("chunk", "tokens").mapInArrow(send, "frag int, chunk long, tokens binary, counts binary")
    frequencies = counted.groupBy("frag").applyInArrow(tidy(count), "chunk long, frag int, df binary")
    return packed.groupBy("chunk").cogroup(frequencies.groupBy("chunk")).applyInArrow(tidy(build), SEGMENT_ROW)


def overlaps(pairs: DataFrame, segs: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) that link: partial overlaps per fragment, summed per pair."""
    left = segs.select(F.col("cid").alias("a"), "frag", F.col("tokens").alias("ta"))
    right = segs.select(F.col("cid").alias("b"), "frag", F.col("tokens").alias("tb"))
    partial = pairs.join(left, "a").join(right, ["b", "frag"])
    return (
        partial.select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("part"))
        .groupBy("a", "b", "na", "nb")
        .agg(F.sum("part").alias("both"))
        .where("100 * both >= 75 * (na + nb - both)")
        .select("a", "b")
    )


def similar_size(a: str, b: str):
    return (F.lit(100) * F.least(a, b)) >= (F.lit(75) * F.greatest(a, b))


def enough(times, a: str, b: str):
    """Can two sets link whose prefixes share that many shingles? Past the prefix lie ``ceil(0.75 n) - 1`` of a set,
    and nothing else beyond the earlier of the two prefix ends; an overlap of 3/7 of both sizes is needed."""
    after = F.ceil(F.greatest(a, b) * 3 / 4) - 1
    return times + after >= F.ceil((F.col(a) + F.col(b)) * 3 / 7)


def near(a: str, b: str):
    """Can two sets link by their sketches? At an overlap of 3/7 of both sizes they differ in 1/7 of them; the shingles
    that only one set has at all differ, of the others at least as many as bits of the sketches."""
    bits = [F.bit_count(F.col(f"s{a}")[i].bitwiseXOR(F.col(f"s{b}")[i])) for i in range(SKETCH)]
    differ = F.col(f"x{a}") + F.col(f"x{b}") + sum(bits[1:], bits[0])
    return F.lit(7) * differ <= F.col(f"n{a}") + F.col(f"n{b}")


def linked(postings: DataFrame, segs: DataFrame, sketches: DataFrame) -> DataFrame | None:
    """(v, root) of the sets that link with another; None if no set does."""
    links, roots = None, None
    for turn in range(ROUNDS + 1):
        held = postings.withColumn("comp", F.col("cid")) if roots is None else (
            postings.join(roots.withColumnRenamed("v", "cid"), "cid", "left").withColumn("comp", F.coalesce("root", "cid")).drop("root")
        )
        held = held.select("token", "cid", "n", "common", "comp")
        if turn < ROUNDS:
            rank = F.struct(-F.col("common"), F.xxhash64("cid")) if turn == 0 else F.xxhash64(F.col("cid"), F.lit(turn))
            leaders = (
                held.groupBy("token")
                .agg(F.min(F.struct(rank.alias("r"), "cid", "n", "comp")).alias("lead"),
                     F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                .where("lo <> hi")
                .select("token", F.col("lead.cid").alias("b"), F.col("lead.n").alias("nb"), F.col("lead.comp").alias("other"))
            )
            pairs = (
                held.join(leaders, "token")
                .where((F.col("comp") != F.col("other")) & similar_size("n", "nb"))
                .groupBy(F.col("cid").alias("a"), F.col("n").alias("na"), "b", "nb")
                .agg(F.count(F.lit(1)).alias("times"))
                .where(enough(F.col("times"), "na", "nb"))
                .groupBy("a", "na")
                .agg(F.max(F.struct("times", "b", "nb")).alias("best"))
                .select("a", "na", "best.b", "best.nb")
            )
        else:
            parts = held.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("size"))
            mains = parts.groupBy("token").agg(F.max(F.struct("size", "comp")).alias("m"), F.count(F.lit(1)).alias("parts"))
            mains = mains.where("parts > 1").select("token", F.col("m.comp").alias("main"))
            mixed = held.join(mains, "token")
            # a pair cannot share more shingles than either set has in buckets of several components
            mixed = mixed.join(mixed.groupBy("cid").agg(F.count(F.lit(1)).alias("most")), "cid").join(sketches, "cid")
            outside = mixed.where("comp <> main").select(
                "token", F.col("cid").alias("a"), F.col("n").alias("na"), F.col("comp").alias("own"), F.col("most").alias("ma"),
                F.col("alone").alias("xa"), F.col("sketch").alias("sa"),
            )
            inside = mixed.select("token", F.col("cid").alias("b"), F.col("n").alias("nb"), "comp", "main", F.col("most").alias("mb"),
                                  F.col("alone").alias("xb"), F.col("sketch").alias("sb"))
            apart = (F.col("own") != F.col("comp")) & ((F.col("comp") == F.col("main")) | (F.col("a") < F.col("b")))
            pairs = (
                outside.join(inside, "token")
                .where(apart & similar_size("na", "nb") & enough(F.least("ma", "mb"), "na", "nb") & near("a", "b"))
                # either end of a pair can be outside, by the bucket: one order, so that its buckets are counted together
                .select(F.when(F.col("a") < F.col("b"), F.struct("a", "na", "b", "nb")).otherwise(
                    F.struct(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb"))).alias("p"))
                .select("p.*")
                .groupBy("a", "na", "b", "nb")
                .agg(F.count(F.lit(1)).alias("times"))
                .where(enough(F.col("times"), "na", "nb"))
                .select("a", "na", "b", "nb")
            )
        found = materialize(overlaps(pairs, segs), "links")
        links = found if links is None else links.unionByName(found)
        if found.limit(1).count():
            roots = components(links)
    return roots


def classed(documents: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n, cid) of every row, and (cid, root) of the sets that link with others."""
    spark = documents.sparkSession
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FRAGMENT_BYTES))
    info = materialize(screened(documents.select("doc_id", "text"), fragments, width), "screened")
    least = F.ceil(F.col("n") * 3 / 4)
    chosen = (
        info.where("n > 0")
        .groupBy("cid")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_hash")).alias("r"), F.max("shared").alias("shared"), F.first("n").alias("n"))
        .where(F.col("shared") >= F.greatest(F.lit(1), F.floor(least / 10)))
        .select("r.doc_id", "r.text_hash")
    )
    segs = materialize(segments(documents, chosen, fragments, width), "segments")
    postings = segs.where(F.col("frag") == PREFIX).select(F.explode("tokens").alias("token"), "cid", "n", "common")
    sketches = segs.where(F.col("frag") == PREFIX).select("cid", "alone", "sketch")
    rest = segs.where(F.col("frag") != PREFIX).select("cid", "frag", "tokens")
    return info, linked(materialize(postings, "postings"), rest, sketches)


def rooted(sets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Add the root of each set: that of its component, or its own key."""
    if roots is None:
        return sets.withColumn("root", F.col("cid"))
    return sets.join(roots.withColumnRenamed("v", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))


def jaccard_components(documents: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (smallest id of an equal set) of every document.

    Sets link at a Jaccard similarity of 75 / 100, compared in whole numbers.
    """
    info, roots = classed(documents, width)
    classes = rooted(info.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("class_id")), roots)
    lowest = classes.groupBy("root").agg(F.min("class_id").alias("component_id"))
    return info.join(classes.join(lowest, "root").drop("root"), "cid", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
    )


def representatives(documents: DataFrame, width: int = 5) -> DataFrame:
    """The documents without all but one of each component: the row of the smallest id stays. Empty sets all stay."""
    info, roots = classed(documents, width)
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_hash")
    sets = rooted(info.where("cid is not null").groupBy("cid").agg(F.min(order).alias("first")), roots)
    first = sets.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_hash")
    first = first.withColumn("_chosen", F.lit(True))
    # one row per id and text: whether it stays, and whether it has to be told from its repetitions
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    keys = info.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"), F.first(F.col("cid").isNull()).alias("empty"))
    kept = keys.join(first.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_chosen"), same, "left")
    kept = kept.where("empty or _chosen").select(*_key("doc_id", "text_hash"), ((F.col("n") > 1) & ~F.col("empty")).alias("_many"))
    kept = materialize(kept, "kept")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_doc"))
    rows = rows.select("_doc", *_key("_doc.doc_id", F.xxhash64("_doc.text")))
    names = ["_id", "_null", "_hash"]
    # the same plan at every size: the texts are dealt once, by id and text
    single = rows.join(kept.where("not _many").hint("merge"), names)
    once = rows.join(kept.where("_many").hint("merge"), names).dropDuplicates(names) if kept.where("_many").limit(1).count() else None
    out = single if once is None else single.unionByName(once)
    return out.select(*[F.col(f"_doc.`{c}`").alias(c) for c in documents.columns])


def _key(doc_id, text_hash) -> list:
    """Id and hash of a row as columns that are never null."""
    doc_id, text_hash = (F.col(c) if isinstance(c, str) else c for c in (doc_id, text_hash))
    return [F.coalesce(doc_id.cast("long"), F.lit(0)).alias("_id"), doc_id.isNull().alias("_null"), text_hash.alias("_hash")]
