"""Merkle manifest of a dataset by time-forward processing.

The digests of a tree are computed in the order of node labels (children before parents): a node that is done sends its
digest to its parent through a priority queue ordered by label, and a node whose turn it is takes what is there for it.
A second sweep runs through the labels backwards and sends every child the digests of its siblings in front of what its
parent got, so at the leaves the proof is complete.

The queue is external. A tree is cut into blocks of ``FANOUT ** levels`` neighbouring nodes, which are whole subtrees;
messages between blocks are rows of a table, which Spark deals out by block and sorts by label, and messages inside a
block are kept in a heap. A block is a bounded number of rows, so neither a language that holds most documents nor a
tree of any size is one task; each round of blocks is written to the shared folder, and there are
log(rows) / log(block) rounds. Leaf digests are computed by Spark's own functions in the scan.

Every subtree of a language is a tree; their roots, in order of the language (null first, then by UTF-8 bytes), are the
leaves of the tree of trees, which is processed the same way.

Defined results. Null fields are hashed as ``-``, so null and empty texts have different leaves. Leaves stand by doc_id,
null ids first, rows of one id by their leaf and equal rows next to each other; each row keeps its own place and proof.
A null id is never tampered with. A language of one document has its leaf for its subroot, a dataset of one language
that subroot for its root; then there are no siblings and the proof is the digest of nothing. An empty table gives an
empty result. Texts are hashed whole. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolex.llm.lookups import looked_up
from arbolex.operators.numbering import number_rows
from arbolex.session import materialize

#: children of a node, and levels of the tree that a block spans
FANOUT, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of the fields, each as ``-`` if null, else its UTF-8 size in bytes, a colon and itself."""
    sized = [F.concat(F.octet_length(c).cast("string"), F.lit(":"), c) for c in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*[F.coalesce(s, F.lit("-")) for s in sized]), 256)


def forward(leaves: Sequence[str], height: int) -> list[list[str]]:
    """The digests of all levels above ``leaves``, by time-forward processing.

    A node's label is (first leaf below it past the end, level): post-order, so a parent comes right after its last
    child and the queue holds at most ``FANOUT - 1`` messages a level.
    """
    levels: list[list[str]] = [list(leaves), *([] for _ in range(height))]
    queue: list[tuple[int, int, int, str]] = []  # label of the receiver (end, level), child's place, digest

    def send(level: int, place: int, value: str) -> None:
        if level < height:
            width = FANOUT ** (level + 1)
            parent = place // FANOUT
            heapq.heappush(queue, (min((parent + 1) * width, len(leaves)), level + 1, place, value))

    for at, leaf in enumerate(leaves):
        send(0, at, leaf)
        while queue and queue[0][0] == at + 1:
            end, level, *_ = queue[0]
            got = []
            while queue and queue[0][:2] == (end, level):
                got.append(heapq.heappop(queue))
            value = digest([message[3] for message in got])
            levels[level].append(value)
            send(level, got[0][2] // FANOUT, value)
    return levels


def backward(levels: list[list[str]], above: list[str]) -> list[list[str]]:
    """For each leaf the steps to the root, nearest first, by the reversed sweep; ``above`` has the steps of the top.

    A step is ``before|after``: the joined digests of the siblings on either side.
    """
    height = len(levels) - 1
    paths: list[list[str]] = [[] for _ in levels[0]]
    queue: list[tuple[int, int, list[str]]] = [(-height, -i, above) for i in range(len(levels[height]))]
    while queue:
        level, place, steps = heapq.heappop(queue)
        level, place = -level, -place
        if level == 0:
            paths[place] = steps
            continue
        first = place * FANOUT
        run = levels[level - 1][first : first + FANOUT]
        for k in range(len(run)):
            step = f"{''.join(run[:k])}|{''.join(run[k + 1 :])}"
            heapq.heappush(queue, (-(level - 1), -(first + k), [step, *steps]))
    return paths


def proof_of(steps: Sequence[str]) -> str:
    """Digest of all siblings on the way to the root."""
    return digest([step.replace("|", "") for step in steps])


def folded(leaf: str, steps: Sequence[str]) -> str:
    """The root that a leaf and the siblings on its way lead to."""
    for step in steps:
        before, after = step.split("|")
        leaf = digest([before, leaf, after])
    return leaf


def rise(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Forward sweep: (nodes of each round, roots) of the trees in ``nodes`` (tree, at, n, value).

    ``at`` counts a tree's nodes from 0, ``n`` is their number. Roots are (tree, value).
    """
    rounds, size = [], FANOUT**levels

    def up(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        n = block.column("n")[0].as_py()
        top = forward(block.column("value").to_pylist(), height_of(n, levels))[-1]
        return pa.table(
            {"tree": [key[0].as_py()], "at": [key[1].as_py()], "n": [-(-n // size)], "value": top},
            pa.schema([("tree", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("value", pa.string())]),
        )

    while True:
        rounds.append(nodes)
        above = nodes.select("tree", F.floor(F.col("at") / size).alias("block"), "at", "n", "value")
        nodes = materialize(
            above.groupBy("tree", "block").applyInArrow(up, "tree long, at long, n long, value string"), "merkle"
        )
        if not nodes.where("n > 1").limit(1).count():
            return rounds, nodes.select("tree", "value")


def height_of(n: int, levels: int) -> int:
    """Levels above the nodes of a block in a tree of ``n`` such nodes: all of them, or those a block spans."""
    height = 0
    while n > 1 and height < levels:
        n = -(-n // FANOUT)
        height += 1
    return height


def fall(rounds: list[DataFrame], above: DataFrame, levels: int, finish: Callable, schema: str) -> DataFrame:
    """Backward sweep: ``finish(block, steps per row)`` of the first round's nodes.

    ``above`` has (tree, at, steps) of the roots.
    """

    def down(then: Callable) -> Callable:
        def run(block: pa.Table, top: pa.Table) -> pa.Table:
            block = block.sort_by("at")
            tree = forward(block.column("value").to_pylist(), height_of(block.column("n")[0].as_py(), levels))
            return then(block, backward(tree, top.column("steps")[0].as_py()))

        return run

    def passed(block: pa.Table, paths: list[list[str]]) -> pa.Table:
        return pa.table(
            {"tree": block.column("tree"), "at": block.column("at"), "steps": pa.array(paths, pa.list_(pa.string()))}
        )

    for k, nodes in reversed(list(enumerate(rounds))):
        left = nodes.withColumn("block", F.floor(F.col("at") / FANOUT**levels)).groupBy("tree", "block")
        right = above.withColumnRenamed("at", "block").groupBy("tree", "block")
        last = k == 0
        above = left.cogroup(right).applyInArrow(
            down(finish if last else passed), schema if last else "tree long, at long, steps array<string>"
        )
        if not last:
            above = materialize(above, "proofs")
    return above


def manifest(documents: DataFrame, with_steps: bool = False, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; with ``with_steps`` its proof too.

    The proof's ``steps`` are the siblings from the leaf to the root, ``before|after`` a level. ``folded_root`` is what
    they make of the leaf that the document has after tampering: where 3 divides the CRC-32 of its id, its text's A-Z
    are lower-cased. ``verified`` is whether that is the root.
    """
    fields = [F.col(f) for f in FIELDS]
    lowered = F.translate(F.col("text"), UPPER, LOWER)
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0) & (lowered != F.col("text"))
    lang = F.coalesce(F.concat(F.lit(":"), F.col("lang").cast("string")), F.lit(""))  # sorts null first
    rows = documents.select(
        "doc_id", lang.alias("lang"), leaf_digest(fields).alias("value"),
        F.when(tampered, leaf_digest([*fields[:-1], lowered])).alias("other"),
    )
    langs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    langs = number_rows(langs, ["lang"], name="tree").select("lang", "n", F.col("tree").cast("long").alias("tree"))
    langs = materialize(langs, "trees")
    count = langs.count()
    # a stable number breaks ties of equal rows, so that no value can fill a sorted partition
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    tagged = looked_up(rows, langs, "lang").drop("lang")
    leaves = number_rows(tagged, ["doc_id", "value", "row"], by=["tree"], name="rn")
    leaves = materialize(leaves.select("tree", (F.col("rn") - 1).alias("at"), "n", "value", "doc_id", "other"), "leaves")
    rounds, subroots = rise(leaves, levels)
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("at"), F.lit(count).cast("long").alias("n"), "value")
    top_rounds, root = rise(materialize(tops, "subroots"), levels)
    found = root.first()
    whole = found["value"] if found else ""

    def of_trees(block: pa.Table, paths: list[list[str]]) -> pa.Table:
        """A subtree's root carries its own digest in front of its steps."""
        steps = [[own, *path] for own, path in zip(block.column("value").to_pylist(), paths, strict=True)]
        trees = [at + 1 for at in block.column("at").to_pylist()]
        return pa.table({"tree": pa.array(trees, pa.int64()), "at": pa.array([0] * len(trees), pa.int64()), "steps": pa.array(steps, pa.list_(pa.string()))})

    none = root.select(F.lit(0).cast("long").alias("tree"), F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("steps"))
    above = materialize(fall(top_rounds, none, levels, of_trees, "tree long, at long, steps array<string>"), "proofs")

    def of_leaves(block: pa.Table, paths: list[list[str]]) -> pa.Table:
        values, others = block.column("value").to_pylist(), block.column("other").to_pylist()
        # the subtree's own digest, which came down with the steps of the tree of trees, is no sibling
        subroots = [next(s for s in path if "|" not in s) for path in paths]
        steps = [[s for s in path if "|" in s] for path in paths]
        ends = [folded(other or value, path) for other, value, path in zip(others, values, steps, strict=True)]
        return pa.table(
            {
                "doc_id": block.column("doc_id"), "leaf": block.column("value"), "subroot": subroots,
                "root": [whole] * len(values), "proof_sha256": list(map(proof_of, steps)), "folded_root": ends,
                "verified": [end == whole for end in ends],
                **({"steps": pa.array(steps, pa.list_(pa.string()))} if with_steps else {}),
            }
        )

    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", steps array<string>" * with_steps
    return fall(rounds, above, levels, of_leaves, schema)
