"""Transition systems as column expressions over a state struct.

A state is ``stack ARRAY<INT>, wptr INT, head ARRAY<INT>, deprel ARRAY<INT>``; positions count from 1.
Moves: 1 shifts, 2l-2 adds a left arc and 2l-1 a right arc with label l >= 2, the last move reduces
(the hybrid one-root system has no reduce).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbolex.functions.labels import N_DEPREL

EAGER, EAGER_R1, HYBRID, HYBRID_R1 = "eager13", "eager_r1", "hybrid13", "hybrid_r1"
SYSTEMS = (EAGER, EAGER_R1, HYBRID, HYBRID_R1)
DEFAULT_SYSTEM = HYBRID_R1

SHIFT = 1
# Fixed value: cost of an illegal move.
ILLEGAL = 32767

STATE = "struct<stack:array<int>,wptr:int,head:array<int>,deprel:array<int>>"


def check_system(system: str) -> str:
    if system not in SYSTEMS:
        raise ValueError(f"unknown transition system {system!r}, expected one of {SYSTEMS}")
    return system


def is_hybrid(system: str) -> bool:
    return check_system(system) in (HYBRID, HYBRID_R1)


def move_count(system: str, labels: int = N_DEPREL) -> int:
    return 2 * labels - (1 if check_system(system) == HYBRID_R1 else 0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for all its uses in ``body``.

    The finish step of a fold over nothing: unlike ``transform`` it does not copy the value.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


def at(array: Column, position: Column) -> Column:
    """Element at a 1-based position, 0 when there is none."""
    return F.coalesce(F.get(array, position - 1), F.lit(0))


def start_state(n: Column) -> Column:
    """First word on the stack, all heads 0 and labels 1."""
    return F.struct(
        F.array(F.lit(1)).alias("stack"),
        F.lit(2).alias("wptr"),
        F.array_repeat(F.lit(0), n).alias("head"),
        F.array_repeat(F.lit(1), n).alias("deprel"),
    )


def frame(state: Column) -> Column:
    """Words in focus: stack size, top ``s0``, below ``s1``, buffer front ``n0`` and the head of s0."""
    size = F.size(state["stack"])
    s0 = at(state["stack"], size)
    return F.struct(
        size.alias("size"),
        s0.alias("s0"),
        at(state["stack"], size - 1).alias("s1"),
        state["wptr"].alias("n0"),
        at(state["head"], s0).alias("s0_head"),
    )


def gold_view(system: str, state: Column, f: Column, heads: Column) -> Column:
    """Gold heads of the words in focus and the gold arcs still open on both sides."""
    s0, n0 = f["s0"], f["n0"]

    def waits(word: Column) -> Column:
        arc = F.get(heads, word - 1) == n0
        # in the hybrid systems no word on the stack has a head
        return arc if is_hybrid(system) else arc & (F.get(state["head"], word - 1) == 0)

    waiting = F.filter(state["stack"], waits)
    ahead = F.filter(heads, lambda h, i: (h == s0) & (i + 1 >= n0))
    return F.struct(
        at(heads, s0).alias("s0_gold"),
        at(heads, n0).alias("n0_gold"),
        F.size(waiting).alias("lost_left"),
        F.size(ahead).alias("lost_right"),
    )


def legality(system: str, state: Column, f: Column, n: Column) -> dict[str, Column]:
    """Which kinds of move are legal: ``shift, reduce, left, right``."""
    size, n0 = f["size"], f["n0"]
    buffer, stack, headless = n0 <= n, size > 0, f["s0_head"] == 0
    if system == EAGER:
        return {
            "shift": buffer,
            "reduce": stack & (~headless | (~buffer & (size > 1))),
            "left": buffer & stack & headless,
            "right": buffer & stack,
        }
    if system == EAGER_R1:
        free = F.size(F.filter(state["stack"], lambda w: at(state["head"], w) == 0))
        return {
            "shift": (n0 < n) | ((n0 == n) & ~stack),
            "reduce": stack & ~headless,
            "left": buffer & stack & headless,
            "right": stack & ((n0 < n) | ((n0 == n) & (free == 1))),
        }
    return {
        "shift": buffer,
        "reduce": (size == 1) & buffer if check_system(system) == HYBRID else F.lit(False),
        "left": buffer & stack,
        "right": size > 1,
    }


def arc_costs(system: str, state: Column, f: Column, g: Column) -> dict[str, Column]:
    """Gold arcs lost by each kind of move, labels aside."""
    s0, s1, n0, size = f["s0"], f["s1"], f["n0"], f["size"]
    s0_gold, n0_gold, lost_left, lost_right = g["s0_gold"], g["n0_gold"], g["lost_left"], g["lost_right"]
    one = lambda cond: cond.cast("int")
    head_in_stack = F.array_contains(state["stack"], n0_gold)
    head_below = (n0_gold != s0) & head_in_stack
    if is_hybrid(system):
        late = lost_right + one(s0_gold >= n0)
        left_lost = (s0_gold > n0) | ((size == 1) & (s0_gold == 0)) | ((size > 1) & (s0_gold == s1))
        return {
            "shift": lost_left + one(head_below) + one((n0_gold == 0) & (size > 0)),
            "reduce": late,
            "left": lost_right + one(left_lost),
            "right": late,
        }
    return {
        "shift": lost_left + one(head_in_stack),
        "reduce": lost_right,
        "left": lost_right + one(s0_gold > n0) + one(s0_gold == 0),
        "right": lost_left + one(n0_gold > n0) + one(n0_gold == 0) + one(head_below),
    }


def arcs(system: str, f: Column) -> dict[str, tuple[Column, Column]]:
    """(head, dependent) of the arc that a left or right move adds."""
    right = (f["s1"], f["s0"]) if is_hybrid(system) else (f["s0"], f["n0"])
    return {"left": (f["n0"], f["s0"]), "right": right}


def cost_summary(system: str, state: Column, heads: Column, deprels: Column, n: Column) -> Column:
    """All move costs in short form.

    ``shift, reduce, left, right``: cost of the kind with the best label, 32767 when illegal;
    ``left_gold, right_gold``: the label for which the arc is gold, 0 when the arc is not gold
    (then all labels cost the same, otherwise each other label costs one more).
    """

    def build(b: Column) -> Column:
        f, g = b["f"], b["g"]
        ok, cost, arc = legality(system, state, f, n), arc_costs(system, state, f, g), arcs(system, f)
        dependent_gold = {"left": g["s0_gold"], "right": g["s0_gold"] if is_hybrid(system) else g["n0_gold"]}
        parts = [F.when(ok[k], cost[k]).otherwise(F.lit(ILLEGAL)).alias(k) for k in ("shift", "reduce", "left", "right")]
        for kind in ("left", "right"):
            head, dep = arc[kind]
            gold = (dep > 0) & (dependent_gold[kind] == head) & ok[kind]
            parts.append(F.when(gold, at(deprels, dep)).otherwise(F.lit(0)).alias(f"{kind}_gold"))
        return F.struct(*parts)

    def focus(f: Column) -> Column:
        return let(F.struct(f.alias("f"), gold_view(system, state, f, heads).alias("g")), build)

    return let(frame(state), focus)


def best_move(system: str, summary: Column) -> Column:
    """Cheapest move as ``cost, move``; ties go to the lowest move number."""
    left = F.when(summary["left_gold"] > 1, 2 * summary["left_gold"] - 2).otherwise(F.lit(2))
    right = F.when(summary["right_gold"] > 1, 2 * summary["right_gold"] - 1).otherwise(F.lit(3))
    moves = {"shift": F.lit(SHIFT), "left": left, "right": right}
    if system != HYBRID_R1:
        moves["reduce"] = F.lit(move_count(system))
    return F.array_min(
        F.array(*[F.struct(summary[k].alias("cost"), m.alias("move")) for k, m in moves.items()])
    )


def move_costs(system: str, summary: Column) -> Column:
    """Cost of every move number as an array.

    Both directions are runs of one value around the gold label, woven together at the end.
    """
    labels = N_DEPREL - 1

    def direction(kind: str) -> Column:
        base, gold = summary[kind], summary[f"{kind}_gold"]
        others = F.array_repeat(base + 1, gold - 2)
        rest = F.array_repeat(base + 1, labels + 1 - gold)
        misplaced = F.array_repeat(base + 1, F.lit(labels))  # a gold arc labelled root has no move
        return (
            F.when(gold > 1, F.concat(others, F.array(base), rest))
            .when(gold == 1, misplaced)
            .otherwise(F.array_repeat(base, F.lit(labels)))
        )

    woven = F.flatten(F.zip_with(direction("left"), direction("right"), lambda a, b: F.array(a, b)))
    last = [] if system == HYBRID_R1 else [F.array(summary["reduce"])]
    return F.concat(F.array(summary["shift"]), woven, *last)


def legal_moves(system: str, state: Column, n: Column) -> Column:
    """Legal kinds as a struct of booleans."""
    return let(
        frame(state), lambda f: F.struct(*[c.alias(k) for k, c in legality(system, state, f, n).items()])
    )


def is_reduce(system: str, move: Column) -> Column:
    return F.lit(False) if system == HYBRID_R1 else move == move_count(system)


def is_left(system: str, move: Column) -> Column:
    return (move % 2 == 0) & ~is_reduce(system, move)


def is_right(move: Column) -> Column:
    return (move % 2 == 1) & (move != SHIFT)


def is_legal(system: str, move: Column, legal: Column) -> Column:
    """Whether a move number is legal, given :func:`legal_moves`; numbers out of range are not."""
    kinds = F.when(move == SHIFT, legal["shift"])
    if system != HYBRID_R1:
        kinds = kinds.when(move == move_count(system), legal["reduce"])
    picked = kinds.when(move % 2 == 0, legal["left"]).otherwise(legal["right"])
    return (move >= 1) & (move <= move_count(system)) & picked


def put_at(array: Column, position: Column, value: Column) -> Column:
    """The array with one element replaced."""
    return F.transform(array, lambda x, i: F.when(i + 1 == position, value).otherwise(x))


def apply_move(system: str, state: Column, move: Column) -> Column:
    """State after a legal move."""

    def build(f: Column) -> Column:
        left, right = is_left(system, move), is_right(move)
        label = F.shiftright(move, 1) + 1
        pairs = arcs(system, f)
        pushes = move == SHIFT if is_hybrid(system) else (move == SHIFT) | right

        def put(array: Column, left_value: Column, right_value: Column) -> Column:
            return (
                F.when(left, put_at(array, pairs["left"][1], left_value))
                .when(right, put_at(array, pairs["right"][1], right_value))
                .otherwise(array)
            )

        return F.struct(
            F.when(pushes, F.array_append(state["stack"], f["n0"]))
            .otherwise(F.filter(state["stack"], lambda _, i: i + 1 < f["size"]))
            .alias("stack"),
            F.when(pushes, f["n0"] + 1).otherwise(f["n0"]).alias("wptr"),
            put(state["head"], pairs["left"][0], pairs["right"][0]).alias("head"),
            put(state["deprel"], label, label).alias("deprel"),
        )

    return let(frame(state), build)


def checked_move(system: str, state: Column, move: Column, n: Column) -> Column:
    """Like :func:`apply_move`, but an illegal or unknown move is an error."""
    legal = legal_moves(system, state, n)
    ok = let(legal, lambda okay: is_legal(system, move, okay))
    return F.when(ok, apply_move(system, state, move)).otherwise(F.raise_error(F.lit("illegal move")))


def is_final(state: Column, n: Column) -> Column:
    """One word on the stack and an empty buffer."""
    return (F.size(state["stack"]) == 1) & (state["wptr"] > n)
