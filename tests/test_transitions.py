import itertools

import pytest
from pyspark.sql import functions as F

from arbolex.functions import transitions as tr
from arbolex.operators import gold
from arbolex.operators import treebank as tb


def forests(longest):
    for n in range(1, longest + 1):
        for heads in itertools.product(range(n + 1), repeat=n):
            if all(_reaches_root(heads, i) for i in range(1, n + 1)):
                yield list(heads)


def _reaches_root(heads, i):
    seen = set()
    while i and i not in seen:
        seen.add(i)
        i = heads[i - 1]
    return i == 0


@pytest.fixture(scope="module")
def small_forests(spark):
    rows = []
    for i, heads in enumerate(forests(4)):
        labels = [1 if h == 0 else 2 + (3 * j + i) % 36 for j, h in enumerate(heads)]
        rows.append((i, len(heads), heads, labels))
    df = spark.createDataFrame(rows, "sent_id long, n int, heads array<int>, deprels array<int>")
    return df.repartition(4)


@pytest.mark.parametrize("system", tr.SYSTEMS)
def test_free_sequence_iff_rebuilt_iff_shape_allows(small_forests, system):
    shapes = tb.crossing(small_forests).select("sent_id", "heads", "deprels", "n_roots", "crosses", "over_root")
    rows = gold.gold_moves(small_forests, system).join(shapes, "sent_id").collect()
    one_root = system in (tr.EAGER_R1, tr.HYBRID_R1)
    for r in rows:
        free = sum(r.costs) == 0
        rebuilt = r["head"] == r.heads and r.deprel == r.deprels
        allowed = not r.crosses and not r.over_root and (r.n_roots == 1 or not one_root)
        assert free == rebuilt == allowed, r
        assert len(r.moves) == 2 * r.n - 2
        if one_root:
            assert r["head"].count(0) == 1
    lost = {r.sent_id for r in gold.unreachable(small_forests, system).collect()}
    assert lost == {r.sent_id for r in rows if sum(r.costs) > 0}


def test_goldens(spark, sentences):
    sents = sentences([2, 0, 2], [3, 4, 0, 3], [0], [0, 0], [3, 0, 0])
    runs = {r.sent_id: r for r in gold.gold_moves(sents).collect()}
    kinds = ["S" if m == 1 else "L" if m % 2 == 0 else "R" for m in runs[1].moves]
    assert kinds == ["L", "S", "S", "R"]
    assert sum(runs[2].costs) > 0 and runs[3].moves == [] and sum(runs[4].costs) > 0
    assert sum({r.sent_id: r for r in gold.gold_moves(sents, tr.HYBRID).collect()}[4].costs) == 0
    for system in tr.SYSTEMS:
        assert 5 in {r.sent_id for r in gold.unreachable(sents, system).collect()}


def brute_costs(system, stack, wptr, head, heads, labels, n):
    """Independent plain-Python costs of all moves, by exhaustive search over continuations.

    Cost of a move = gold (head, label) pairs that become unreachable by it. Labels are free until an
    arc is made, so only an arc with a wrong label loses one more.
    """
    hybrid = system in (tr.HYBRID, tr.HYBRID_R1)

    def legal(st, w, hd):
        s0 = st[-1] if st else 0
        if system == tr.EAGER:
            ok = {"S": w <= n, "D": bool(st) and (hd[s0 - 1] != 0 or (w > n and len(st) > 1))}
            ok["L"] = w <= n and bool(st) and hd[s0 - 1] == 0
            ok["R"] = w <= n and bool(st)
        elif system == tr.EAGER_R1:
            free = sum(1 for x in st if hd[x - 1] == 0)
            ok = {"S": w < n or (w == n and not st), "D": bool(st) and hd[s0 - 1] != 0}
            ok["L"] = bool(st) and w <= n and hd[s0 - 1] == 0
            ok["R"] = bool(st) and (w < n or (w == n and free == 1))
        else:
            ok = {"S": w <= n, "D": system == tr.HYBRID and len(st) == 1 and w <= n}
            ok["L"] = w <= n and bool(st)
            ok["R"] = len(st) > 1
        return ok

    def go(st, w, hd, kind):
        st, hd = list(st), list(hd)
        if kind == "S":
            return st + [w], w + 1, hd
        if kind == "D":
            return st[:-1], w, hd
        if kind == "L":
            hd[st[-1] - 1] = w
            return st[:-1], w, hd
        if hybrid:
            hd[st[-1] - 1] = st[-2]
            return st[:-1], w, hd
        hd[w - 1] = st[-1]
        return st + [w], w + 1, hd

    def reachable(st, w, hd):
        """Gold arcs each on its own still possible from here."""
        found, todo, seen = set(), [(tuple(st), w, tuple(hd))], set()
        while todo:
            state = todo.pop()
            if state in seen:
                continue
            seen.add(state)
            s, p, h = state
            found |= {d for d in range(1, n + 1) if h[d - 1] == heads[d - 1] != 0}
            for kind, ok in legal(s, p, h).items():
                if ok:
                    ns, nw, nh = go(s, p, h, kind)
                    todo.append((tuple(ns), nw, tuple(nh)))
        return found

    before = reachable(stack, wptr, head)
    out = {}
    for kind, ok in legal(stack, wptr, head).items():
        if ok:
            out[kind] = len(before - reachable(*go(stack, wptr, head, kind)))
    return out


@pytest.mark.parametrize("system", (tr.HYBRID_R1, tr.HYBRID, tr.EAGER, tr.EAGER_R1))
def test_legal_kinds_match_plain_python_and_replay_is_exact(small_forests, system):
    states = gold.gold_states(small_forests.where("n > 1"), system)
    rows = states.withColumn("ok", tr.legal_moves(system, F.col("state"), F.col("n"))).collect()
    for r in rows:
        s = r.state
        want = brute_costs(system, s.stack, s.wptr, list(s["head"]), r.heads, r.deprels, r.n)
        got = {k for k, v in zip("SDLR", (r.ok["shift"], r.ok["reduce"], r.ok["left"], r.ok["right"])) if v}
        assert got == set(want)


def test_cheapest_moves_lose_nothing_on_reachable_trees(small_forests):
    """On trees that can be built, a move is free exactly when the search loses no gold arc."""
    system = tr.HYBRID_R1
    good = small_forests.where("n > 1").join(gold.unreachable(small_forests, system), "sent_id", "left_anti")
    states = gold.gold_states(good, system)
    summary = tr.cost_summary(system, F.col("state"), F.col("heads"), F.col("deprels"), F.col("n"))
    for r in states.withColumn("c", summary).collect():
        s = r.state
        want = brute_costs(system, s.stack, s.wptr, list(s["head"]), r.heads, r.deprels, r.n)
        got = {"S": r.c["shift"], "D": r.c["reduce"], "L": r.c["left"], "R": r.c["right"]}
        for kind, cost in got.items():
            assert (cost < tr.ILLEGAL) == (kind in want)
            if kind in want and kind != "S":  # a shift may also lose the root, which is no arc
                assert (cost == 0) <= (want[kind] == 0), (r, kind)


def test_cost_array_and_ties(spark, sentences):
    states = gold.gold_states(sentences(([2, 0, 2], [5, 1, 7])).select("sent_id", "n", "heads", "deprels"))
    summary = tr.cost_summary(tr.HYBRID_R1, F.col("state"), F.col("heads"), F.col("deprels"), F.col("n"))
    costs = tr.let(summary, lambda s: tr.move_costs(tr.HYBRID_R1, s))
    first = states.withColumn("c", costs).where("step = 1").first()
    assert len(first.c) == 73 and first.move == 2 * 5 - 2
    assert first.c[first.move - 1] == 0 and first.c[1] == 1 and first.c[2] == tr.ILLEGAL


def test_illegal_move_is_an_error(spark, sentences):
    state = sentences([2, 0]).withColumn("s", tr.start_state(F.col("n")))
    for move in (3, 0, 74):
        with pytest.raises(Exception, match="illegal move"):
            state.select(tr.checked_move(tr.HYBRID_R1, F.col("s"), F.lit(move), F.col("n"))).collect()
    with pytest.raises(ValueError):
        tr.check_system("nivre")
