"""Gold transition sequences and the state rows along them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolex.functions import lockstep as ls
from arbolex.functions import transitions as tr

#: ``(states, step, cost, move)`` to an array per sum
Visit = Callable[[ls.States, int, np.ndarray, np.ndarray], Sequence[np.ndarray]]


def _fold(system: str, start: Column, body) -> Column:
    """Run ``body`` once for each of the 2n - 2 moves of a sentence."""
    steps = F.when(F.col("n") > 1, F.sequence(F.lit(1), 2 * F.col("n") - 2)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, body)


def _choice(system: str, state: Column) -> Column:
    summary = tr.cost_summary(system, state, F.col("heads"), F.col("deprels"), F.col("n"))
    return tr.let(summary, lambda s: tr.best_move(system, s))


def gold_moves(sents: DataFrame, system: str = tr.DEFAULT_SYSTEM, keep: Sequence[str] = ()) -> DataFrame:
    """``sent_id, n, moves, costs, head, deprel``: the cheapest move at every step and the tree it gives.

    Sentences never leave their partition; those of an Arrow batch take their moves in step (``functions.lockstep``).
    Sentences must be sound. The columns named in ``keep`` come along.
    """
    tr.check_system(system)

    def run(n, heads, deprels):
        states, steps = ls.States(system, n, heads, deprels), np.maximum(2 * n - 2, 0)
        taken = np.zeros((2, len(n), max(1, int(steps[0]))), np.int32)

        for _, step, cost, move in ls.follow(states):
            taken[0, : len(move), step - 1], taken[1, : len(move), step - 1] = move, cost
        trees = [ls.lists(states[k][:, 1:], n) for k in ("head", "deprel")]
        return pa.StructArray.from_arrays([*(ls.lists(t, steps) for t in taken), *trees], ["moves", "costs", "head", "deprel"])

    names = ("moves", "costs", "head", "deprel")
    kind = pa.struct([(k, pa.list_(pa.int32())) for k in names])
    made = _udf(run, kind, "struct<moves:array<int>,costs:array<int>,head:array<int>,deprel:array<int>>")
    own = [c for c in keep if c not in ("heads", "deprels")]
    rows = sents.select("sent_id", "n", "heads", "deprels", *own, made("n", "heads", "deprels").alias("run"))
    return rows.select("sent_id", "n", *keep, *[f"run.{k}" for k in names])


def replay(runs: DataFrame, system: str = tr.DEFAULT_SYSTEM) -> DataFrame:
    """Add ``end``: the state that the ``moves`` of a sentence lead to, made one by one. An illegal or unknown move is an error."""
    tr.check_system(system)
    kind = pa.struct([(k, pa.int32() if k == "wptr" else pa.list_(pa.int32())) for k in ("stack", "wptr", "head", "deprel")])

    def run(n, moves):
        sizes = pc.fill_null(pc.list_value_length(moves), 0).to_numpy(zero_copy_only=False)
        longest = np.argsort(-sizes, kind="stable")  # whatever number of moves is given
        states, todo = ls.States(system, n[longest]), ls.matrix(moves.take(pa.array(longest)), int(sizes.max()) + 1)
        for step in range(1, todo.shape[1]):
            now = states.first(int(np.searchsorted(-sizes[longest], -step, side="right")))
            move = todo[: len(now["n"]), step]
            if not now.allows(move).all():
                raise ValueError("illegal move")
            now.apply(move)
        return states.as_structs().take(pa.array(np.argsort(longest)))

    def batch(n: pa.Array, moves: pa.Array) -> pa.Array:
        return ls.by_blocks(run, kind, n, moves)

    return runs.withColumn("end", F.arrow_udf(batch, tr.STATE).asNondeterministic()("n", "moves"))


def _udf(run: Callable[..., pa.Array], kind: pa.DataType, ddl: str):
    """``run(n, heads, deprels, *given)`` over blocks of sentences as a function of columns."""

    # one function for each number of columns, which Spark takes from the signature
    def batch(n: pa.Array, heads: pa.Array, deprels: pa.Array) -> pa.Array:
        return ls.by_blocks(run, kind, n, heads, deprels)

    def wider(n: pa.Array, heads: pa.Array, deprels: pa.Array, given: pa.Array) -> pa.Array:
        return ls.by_blocks(run, kind, n, heads, deprels, *given.flatten())

    def made(*columns: str) -> Column:
        # not deterministic for the optimizer: it would compute the column once for every field taken from it
        if len(columns) == 3:
            return F.arrow_udf(batch, ddl).asNondeterministic()(*columns)
        return F.arrow_udf(wider, ddl).asNondeterministic()(*columns[:3], F.struct(*columns[3:]))

    return made


def sums_over_states(
    sents: DataFrame, names: Sequence[str], visit: Visit, given: Sequence[str] = (), system: str = tr.DEFAULT_SYSTEM,
    kind: str = "bigint",
) -> DataFrame:
    """Add ``total``: the sums ``names`` (``bigint``, ``double``) of what ``visit`` gives for the states before each gold move.

    ``visit(states, step, cost, move)`` gives an array per name. Array columns of the sentence that it needs are named in
    ``given``; it finds them in the states. No row per state, nothing leaves the sentence.
    """
    tr.check_system(system)
    number = {"bigint": np.int64, "double": np.float64}[kind]

    def run(n, heads, deprels, *more):
        states = ls.States(system, n, heads, deprels)
        for name, column in zip(given, more, strict=True):
            states.give(name, column)
        total = np.zeros((len(names), len(n)), number)
        for now, step, cost, move in ls.follow(states):
            for sums, values in zip(total, visit(now, step, cost, move), strict=True):
                sums[: len(move)] += values
        return pa.StructArray.from_arrays([pa.array(sums) for sums in total], list(names))

    types = pa.struct([(k, pa.from_numpy_dtype(number)) for k in names])
    made = _udf(run, types, f"struct<{','.join(f'{k}:{kind}' for k in names)}>")
    return sents.withColumn("total", made("n", "heads", "deprels", *given))


def over_states(sents: DataFrame, zero: Column, add: Callable[..., Column], system: str = tr.DEFAULT_SYSTEM) -> DataFrame:
    """Add ``total``: ``add(total, state, step, best)`` folded over the states before each gold move, from ``zero``.

    For sums along the sequences: no row per state, nothing leaves the sentence.
    """
    tr.check_system(system)
    start = F.struct(tr.start_state(F.col("n")).alias("state"), zero.alias("total"))

    def step(acc: Column, i: Column) -> Column:
        return tr.let(
            _choice(system, acc["state"]),
            lambda best: F.struct(
                tr.apply_move(system, acc["state"], best["move"]).alias("state"),
                add(acc["total"], acc["state"], i, best).alias("total"),
            ),
        )

    return sents.withColumn("total", _fold(system, start, step)["total"])


def with_lost(sents: DataFrame, name: str, system: str = tr.DEFAULT_SYSTEM) -> DataFrame:
    """Add whether the system cannot rebuild the gold tree: some step has no free move."""
    flagged = sums_over_states(sents, ("lost",), lambda _now, _step, cost, _move: (cost > 0,), system=system)
    return flagged.withColumn(name, F.col("total.lost") > 0).drop("total")


def gold_states(sents: DataFrame, system: str = tr.DEFAULT_SYSTEM) -> DataFrame:
    """One row per sentence and step: ``step, state`` before the move, ``move`` and ``cost``.

    Other columns of ``sents`` come along on every row, so pass only those needed.
    """
    tr.check_system(system)

    def run(batches):
        for batch in batches:
            n = batch.column("n").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for rows in ls.blocks(n):
                part = batch.take(pa.array(rows))
                for now, step, cost, move in ls.follow(ls.States(system, n[rows], part.column("heads"), part.column("deprels"))):
                    yield pa.RecordBatch.from_arrays(
                        [
                            *part.slice(0, len(move)).columns, pa.array(np.full(len(move), step, np.int32)), now.as_structs(),
                            pa.array(move.astype(np.int32)), pa.array(cost.astype(np.int32)),
                        ],
                        [*part.schema.names, "step", "state", "move", "cost"],
                    )

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sents.schema.fields)
    return sents.mapInArrow(run, f"{own}, step int, state {tr.STATE}, move int, cost int")


def packed_states(sents: DataFrame, system: str = tr.DEFAULT_SYSTEM) -> DataFrame:
    """Parser states of the gold sequences as bytes, to be counted: ``n, packed, copies``, several rows of a state allowed.

    Two states of sentences of one length are the same where their bytes are. Copies within a block are added up.
    """
    tr.check_system(system)

    def run(batches):
        for batch in batches:
            n = batch.column("n").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for rows in ls.blocks(n):
                part = batch.take(pa.array(rows))
                for now, *_ in ls.follow(ls.States(system, n[rows], part.column("heads"), part.column("deprels"))):
                    packed = pa.table({"n": now["n"].astype(np.int32), "packed": now.packed()})
                    found = packed.group_by(["n", "packed"]).aggregate([([], "count_all")])
                    yield from found.rename_columns(["n", "packed", "copies"]).combine_chunks().to_batches()

    return sents.select("n", "heads", "deprels").mapInArrow(run, "n int, packed binary, copies long")


def unreachable(sents: DataFrame, system: str = tr.DEFAULT_SYSTEM) -> DataFrame:
    """Sentences whose gold tree the system cannot rebuild: some step has no free move."""
    runs = gold_moves(sents, system)
    return runs.where(F.exists("costs", lambda c: c > 0)).select("sent_id")
