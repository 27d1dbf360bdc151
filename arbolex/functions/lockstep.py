"""The transition systems over arrays: the sentences of an Arrow batch take their moves in step.

The rules are those of ``transitions``; here one numpy operation serves a whole block of sentences, where a column
expression is interpreted word by word. Spark deals the rows; a block is bounded in cells, so a long sentence stands alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from arbolex.functions import transitions as tr
from arbolex.functions.labels import N_DEPREL

#: words, padding included, of the sentences that move together
CELLS = 1 << 17


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """A list per row as rows of ``width`` cells, from cell 1 on; 0 where there is nothing."""
    out = np.zeros((len(lists), width), np.int32)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    values = pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lists)), sizes)
    cells = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    inside = cells < width
    out[rows[inside], cells[inside]] = values[inside]
    return out


def lists(cells: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The first ``sizes`` cells of every row as a list per row."""
    values = cells[np.arange(cells.shape[1]) < sizes[:, None]]
    return pa.ListArray.from_arrays(offsets(sizes), pa.array(values.astype(np.int32)))


def offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def blocks(n: np.ndarray, copies: int = 1) -> Iterator[np.ndarray]:
    """Rows that move together, longest sentences first, ``copies`` states each."""
    order, done = np.argsort(-n, kind="stable"), 0
    while done < len(order):
        rows = max(1, CELLS // (copies * (int(n[order[done]]) + 3)))
        yield order[done : done + rows]
        done += rows


def by_blocks(run: Callable[..., pa.Array], kind: pa.DataType, n: pa.Array, *columns: pa.Array, copies: int = 1) -> pa.Array:
    """``run(n, *columns)`` block by block; its results in the order of the rows."""
    sizes = pc.fill_null(n, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    parts, order = [], []
    for rows in blocks(sizes, copies):
        picked = pa.array(rows)
        parts.append(run(sizes[rows], *[c.take(picked) for c in columns]).cast(kind))
        order.append(rows)
    if not parts:
        return pa.array([], kind)
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(order))))


def tensor(lists: pa.Array, width: int) -> np.ndarray:
    """A list of vectors per row, from cell 1 on; zeros where there is nothing."""
    vectors = pc.fill_null(lists.flatten().flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    count = int(sizes.sum())
    vectors = vectors.reshape(count, -1) if count else np.zeros((0, 1))
    out = np.zeros((len(lists), width, vectors.shape[1]))
    rows = np.repeat(np.arange(len(lists)), sizes)
    out[rows, np.arange(count) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1] = vectors
    return out


class States:
    """One state a row. With gold ``heads`` and ``deprels`` the counts that the costs need are kept along the moves.

    Cells count from 1; cell 0 stands for no word and the last one for places outside the sentence.
    """

    def __init__(self, system: str, n: np.ndarray, heads: pa.Array | None = None, deprels: pa.Array | None = None):
        self.system, self.width = tr.check_system(system), int(n.max(initial=0)) + 3
        rows, width = len(n), self.width
        cells = lambda: np.zeros((rows, width), np.int32)
        self.data = {"n": n, "size": np.ones(rows, np.int64), "wptr": np.full(rows, 2)}
        self.data |= {"stack": cells(), "head": cells(), "deprel": np.ones((rows, width), np.int32)}
        self.data["stack"][:, 1] = 1
        self.data["deprel"][:, 0] = 0
        if heads is not None:
            gold = matrix(heads, width)
            inside = (gold >= 0) & (gold < width - 1)
            slot = np.where(inside, gold, width - 1).astype(np.int32)
            place = np.arange(width)
            waits = (place >= 2) & (place <= n[:, None])
            at = (np.arange(rows)[:, None] * width + slot)[waits]
            ahead = np.bincount(at, minlength=rows * width).reshape(rows, width).astype(np.int32)
            waiting, in_stack = cells(), np.zeros((rows, width), bool)
            waiting[np.arange(rows), slot[:, 1]] = 1
            in_stack[:, 1] = True
            self.data |= {"heads": gold, "deprels": matrix(deprels, width), "slot": slot, "ahead": ahead, "waiting": waiting}
            self.data |= {"in_stack": in_stack}
        if system == tr.EAGER_R1:
            self.data["free"] = np.ones(rows, np.int64)
        self.base = np.arange(rows) * width

    def _derived(self, pick) -> States:
        out = object.__new__(States)
        out.system, out.width = self.system, self.width
        out.data = {k: v[pick] for k, v in self.data.items()}
        out.base = np.arange(len(out.data["n"])) * self.width
        return out

    def first(self, rows: int) -> States:
        """The first rows, which share their cells with these."""
        return self._derived(slice(0, rows))

    def take(self, rows: np.ndarray) -> States:
        """A copy of the rows named."""
        return self._derived(rows)

    def put(self, rows: np.ndarray, states: States) -> None:
        """Replace the rows named."""
        for name, cells in states.data.items():
            self.data[name][rows] = cells

    def give(self, name: str, column: pa.Array) -> None:
        """Keep an array column of the sentences by the cells of its words."""
        nested = pa.types.is_list(column.type.value_type)
        self.data[name] = tensor(column, self.width) if nested else matrix(column, self.width)

    def as_structs(self) -> pa.Array:
        """The states as they stand in ``transitions.STATE``."""
        parts = [lists(self["stack"][:, 1:], self["size"]), pa.array(self["wptr"].astype(np.int32))]
        parts += [lists(self[k][:, 1:], self["n"]) for k in ("head", "deprel")]
        return pa.StructArray.from_arrays(parts, ["stack", "wptr", "head", "deprel"])

    def __getitem__(self, name: str) -> np.ndarray:
        return self.data[name]

    def at(self, name: str, cell: np.ndarray) -> np.ndarray:
        return self.data[name].reshape(-1)[self.base + cell]

    def frame(self) -> tuple[np.ndarray, ...]:
        """Stack size, top ``s0``, below ``s1``, buffer front ``n0`` and the head of s0."""
        size = self["size"]
        s0 = self.at("stack", size)
        return size, s0, self.at("stack", np.maximum(size - 1, 0)), self["wptr"], self.at("head", s0)

    def legality(self) -> dict[str, np.ndarray]:
        """See ``transitions.legality``."""
        size, _, _, n0, s0_head = self.frame()
        n, stack, headless = self["n"], size > 0, s0_head == 0
        buffer = n0 <= n
        if self.system == tr.EAGER:
            return {
                "shift": buffer, "reduce": stack & (~headless | (~buffer & (size > 1))), "left": buffer & stack & headless,
                "right": buffer & stack,
            }
        if self.system == tr.EAGER_R1:
            last = n0 == n
            return {
                "shift": (n0 < n) | (last & ~stack), "reduce": stack & ~headless, "left": buffer & stack & headless,
                "right": stack & ((n0 < n) | (last & (self["free"] == 1))),
            }
        reduce = (size == 1) & buffer if self.system == tr.HYBRID else np.zeros(len(n), bool)
        return {"shift": buffer, "reduce": reduce, "left": buffer & stack, "right": size > 1}

    def allows(self, move: np.ndarray) -> np.ndarray:
        """Whether a move is legal, see ``transitions.is_legal``."""
        ok, last = self.legality(), tr.move_count(self.system)
        out = np.where(move % 2 == 0, ok["left"], ok["right"])
        if self.system != tr.HYBRID_R1:
            out = np.where(move == last, ok["reduce"], out)
        return np.where(move == tr.SHIFT, ok["shift"], out) & (move >= 1) & (move <= last)

    def all_allowed(self) -> np.ndarray:
        """Whether each move is legal, a column each."""
        ok = self.legality()
        out = np.empty((len(self["n"]), tr.move_count(self.system)), bool)
        out[:, 0] = ok["shift"]
        out[:, 1 : 2 * N_DEPREL - 1 : 2], out[:, 2 : 2 * N_DEPREL - 1 : 2] = ok["left"][:, None], ok["right"][:, None]
        if self.system != tr.HYBRID_R1:
            out[:, -1] = ok["reduce"]
        return out

    def packed(self) -> pa.Array:
        """A state as bytes, for all sentences of the block; the same bytes mean the same state in sentences of one length.

        Of the words in the buffer nothing is known yet, so a state ends with the last word before it.
        """
        known = self["wptr"] - 1
        out = np.empty(len(known), object)
        for kind, rows in ((np.uint8, self["n"] < 250), (np.uint32, self["n"] >= 250)):
            rows = np.flatnonzero(rows)
            if not len(rows):
                continue
            used = int(known[rows].max())
            stack = np.where(np.arange(1, used + 1) <= self["size"][rows, None], self["stack"][rows, 1 : used + 1], 0)
            cells = np.stack([stack, self["head"][rows, 1 : used + 1], self["deprel"][rows, 1 : used + 1]], 2).astype(kind)
            raw, size = cells.tobytes(), cells[0].nbytes
            ends = known[rows] * 3 * cells.itemsize
            out[rows] = [raw[i * size : i * size + end] for i, end in enumerate(ends.tolist())]
        return pa.array(out, pa.binary())

    def costs(self) -> dict[str, np.ndarray]:
        """See ``transitions.cost_summary``."""
        size, s0, s1, n0, _ = self.frame()
        hybrid = tr.is_hybrid(self.system)
        s0_gold, n0_gold = self.at("heads", s0), self.at("heads", n0)
        lost_left, lost_right = self.at("waiting", n0), self.at("ahead", s0)
        in_stack = self.at("in_stack", self.at("slot", n0))
        below = (n0_gold != s0) & in_stack
        if hybrid:
            late = lost_right + (s0_gold >= n0)
            left_lost = (s0_gold > n0) | ((size == 1) & (s0_gold == 0)) | ((size > 1) & (s0_gold == s1))
            cost = {"shift": lost_left + below + ((n0_gold == 0) & (size > 0)), "reduce": late, "left": lost_right + left_lost, "right": late}
            arcs = {"left": (n0, s0, s0_gold), "right": (s1, s0, s0_gold)}
        else:
            cost = {
                "shift": lost_left + in_stack, "reduce": lost_right, "left": lost_right + (s0_gold > n0) + (s0_gold == 0),
                "right": lost_left + (n0_gold > n0) + (n0_gold == 0) + below,
            }
            arcs = {"left": (n0, s0, s0_gold), "right": (s0, n0, n0_gold)}
        ok = self.legality()
        out = {k: np.where(ok[k], c, tr.ILLEGAL) for k, c in cost.items()}
        for kind, (head, dep, gold) in arcs.items():
            out[f"{kind}_gold"] = np.where((dep > 0) & (gold == head) & ok[kind], self.at("deprels", dep), 0)
        return out

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """Cost and number of the cheapest move, see ``transitions.best_move``."""
        found = self.costs()
        moves = {"shift": tr.SHIFT}
        for kind, other in (("left", 2), ("right", 3)):
            gold = found[f"{kind}_gold"]
            moves[kind] = np.where(gold > 1, 2 * gold + other - 4, other)
        if self.system != tr.HYBRID_R1:
            moves["reduce"] = tr.move_count(self.system)
        key = None
        for kind, move in moves.items():
            ranked = (found[kind].astype(np.int64) << 16) + move
            key = ranked if key is None else np.minimum(key, ranked)
        return key >> 16, key & 0xFFFF

    def move_costs(self) -> np.ndarray:
        """Cost of every move, a column each, see ``transitions.move_costs``."""
        found = self.costs()
        out = np.empty((len(self["n"]), tr.move_count(self.system)), np.int32)
        out[:, 0] = found["shift"]
        rows = np.arange(len(out))
        for kind, start in (("left", 1), ("right", 2)):
            base, gold = found[kind], found[f"{kind}_gold"]
            out[:, start : 2 * N_DEPREL - 1 : 2] = (base + (gold > 0))[:, None]
            right = gold > 1
            out[rows[right], 2 * gold[right] - 4 + start] = base[right]
        if self.system != tr.HYBRID_R1:
            out[:, -1] = found["reduce"]
        return out

    def apply(self, move: np.ndarray) -> None:
        """Make a legal move in every row, in place."""
        size, s0, s1, n0, s0_head = self.frame()
        hybrid = tr.is_hybrid(self.system)
        shift, odd = move == tr.SHIFT, (move & 1) == 1
        reduce = move == tr.move_count(self.system) if self.system != tr.HYBRID_R1 else np.zeros(len(move), bool)
        left, right = ~odd & ~reduce, odd & ~shift
        push = shift if hybrid else shift | right
        word = np.where(push, n0, s0)
        if "heads" in self.data:
            slot = self.base + self.at("slot", word)
            self["ahead"].reshape(-1)[slot] -= push
            self["waiting"].reshape(-1)[slot] += shift.astype(np.int32) - (~push & (s0_head == 0) & (s0 > 0))
            self["in_stack"].reshape(-1)[self.base + word] = push
        if "free" in self.data:
            self["free"][:] += shift.astype(np.int64) - (~push & (s0_head == 0) & (s0 > 0))
        head, dep = np.where(left, n0, s1 if hybrid else s0), s0 if hybrid else np.where(left, s0, n0)
        place = self.base + np.where((left | right) & (dep > 0), dep, self.width - 1)
        self["head"].reshape(-1)[place] = head
        self["deprel"].reshape(-1)[place] = (move >> 1) + 1
        self["stack"].reshape(-1)[self.base + np.where(push, size + 1, self.width - 1)] = n0
        self["size"][:] = np.where(push, size + 1, np.maximum(size - 1, 0))
        self["wptr"][:] += push


def going(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Every step, and how many rows, longest sentences first, still have a move to make."""
    steps = np.maximum(2 * n - 2, 0)
    for step in range(1, int(steps[0]) + 1):
        yield step, int(np.searchsorted(-steps, -step, side="right"))


def follow(states: States) -> Iterator[tuple[States, int, np.ndarray, np.ndarray]]:
    """Make the cheapest moves to the end: the states before each move, its number, its cost and the move."""
    for step, rows in going(states["n"]):
        now = states.first(rows)
        cost, move = now.best()
        yield now, step, cost, move
        now.apply(move)
