"""The largest common connected part of two molecules, by growing a mapping one atom at a time.

The search is a stack of states, each a mapping with the pairs that it may not take any more, so it can stop anywhere and
go on elsewhere: :func:`moleweave.operators.matching.common_parts` deals what is left out over Spark, round by round.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moleweave.functions.slices import ROWS, rows_of
from moleweave.functions.writer import pattern_text

#: States looked at for one pair; beyond it the best part so far is given, with timed_out.
MOST_STEPS = 200_000
RESULT = T.StructType([T.StructField("left", T.ArrayType(T.IntegerType())), T.StructField("right", T.ArrayType(T.IntegerType())), T.StructField("n_bonds", T.IntegerType()), T.StructField("timed_out", T.BooleanType())])
ARROW_RESULT = pa.struct([("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32())), ("n_bonds", pa.int32()), ("timed_out", pa.bool_())])


class State(NamedTuple):
    """A mapping with its common bonds, the pairs that it may not take, and atoms of the left that are out for good."""

    pairs: dict[int, int]
    n_bonds: int
    banned: frozenset[tuple[int, int]]
    out: frozenset[int]


START = State({}, 0, frozenset(), frozenset())


class Search:
    """Atoms agree in element, bonds in kind; of common parts the one with most bonds, then atoms, is looked for."""

    def __init__(self, a: dict, b: dict) -> None:
        self.za, self.zb = ([x["z"] for x in m["atoms"]] for m in (a, b))
        self.na, self.nb = ([{n["v"]: m["bonds"][n["k"]]["kind"] for n in x["near"]} for x in m["atoms"]] for m in (a, b))
        self.order = sorted(range(len(self.za)), key=lambda v: (len(self.na[v]), v))
        kind = lambda z, near, v, w: (*sorted((z[v], z[w])), near[v][w])
        self.types_a = {(v, w): kind(self.za, self.na, v, w) for v, found in enumerate(self.na) for w in found}
        self.types_b = {(v, w): kind(self.zb, self.nb, v, w) for v, found in enumerate(self.nb) for w in found}
        self.top = sum((Counter(t for (v, w), t in self.types_a.items() if v < w) & Counter(t for (v, w), t in self.types_b.items() if v < w)).values())

    def options(self, s: State) -> dict[int, list[int]]:
        """Atoms next to the mapping with the atoms that they can be mapped to by a common bond."""
        used, out = set(s.pairs.values()), {}
        for v, x in s.pairs.items():
            for w, kind in self.na[v].items():
                if w not in s.pairs and w not in s.out:
                    out.setdefault(w, set()).update(y for y, k in self.nb[x].items() if k == kind and y not in used and self.zb[y] == self.za[w] and (w, y) not in s.banned)
        return {w: sorted(ys) for w, ys in out.items()}

    def most(self, s: State, options: dict[int, list[int]]) -> tuple[int, int]:
        """Bonds and atoms that the state can come to at most: those that can still be reached, by their types."""
        seen = set(s.pairs) if s.pairs else {v for v in range(len(self.za)) if v not in s.out}
        front = [w for w, ys in options.items() if ys]
        seen.update(front)
        while front:
            v = front.pop()
            for w in self.na[v]:
                if w not in seen and w not in s.out:
                    seen.add(w)
                    front.append(w)
        images = set(s.pairs.values())
        left = Counter(t for (v, w), t in self.types_a.items() if v < w and v in seen and w in seen and not (v in s.pairs and w in s.pairs))
        right = Counter(t for (v, w), t in self.types_b.items() if v < w and not (v in images and w in images))
        return s.n_bonds + sum((left & right).values()), len(s.pairs) + sum((Counter(self.za[v] for v in seen if v not in s.pairs) & Counter(z for y, z in enumerate(self.zb) if y not in images)).values())

    def children(self, s: State, options: dict[int, list[int]]) -> list[State]:
        """The states after one atom is decided: last the one with its first choice."""
        if not s.pairs:
            v = next((v for v in self.order if v not in s.out), None)
            if v is None:
                return []
            starts = [y for y in sorted(range(len(self.zb)), key=lambda y: (len(self.nb[y]), y)) if self.zb[y] == self.za[v]]
            return [State({}, 0, frozenset(), s.out | {v}), *(State({v: y}, 0, frozenset(), s.out) for y in reversed(starts))]
        live = {w: ys for w, ys in options.items() if ys}
        if not live:
            return []
        w = min(live, key=lambda w: (len(live[w]), w))
        out = [s._replace(banned=s.banned | {(w, y) for y in live[w]})]
        for y in reversed(live[w]):
            won = sum(1 for v, kind in self.na[w].items() if v in s.pairs and self.nb[s.pairs[v]].get(y) == kind)
            out.append(State(s.pairs | {w: y}, s.n_bonds + won, s.banned, s.out))
        return out

    def run(self, stack: list[State], best: tuple[tuple[int, int], dict[int, int]], most: int | None) -> tuple[tuple[tuple[int, int], dict[int, int]], list[State]]:
        """The best part after ``most`` states, or all of them, and the states that are left."""
        steps = 0
        while stack and (most is None or steps < most):
            steps += 1
            s = stack.pop()
            if s.pairs and (s.n_bonds, len(s.pairs)) > best[0]:
                best = (s.n_bonds, len(s.pairs)), s.pairs
            options = self.options(s)
            if best[0] < (self.top, min(len(self.za), len(self.zb))) and self.most(s, options) > best[0]:
                stack += self.children(s, options)
        return best, stack


NONE: tuple[tuple[int, int], dict[int, int]] = ((-1, -1), {})


def common_part(a: dict, b: dict, most: int | None = MOST_STEPS) -> dict:
    """Atom pairs of the connected common part with most bonds, then atoms: equal elements, bonds of equal kind.

    With ``most`` None the search goes on to its end.
    """
    best, left = Search(a, b).run([START], NONE, most)
    pairs = sorted(best[1].items())
    return {"left": [v for v, _ in pairs], "right": [y for _, y in pairs], "n_bonds": max(0, best[0][0]), "timed_out": bool(left)}


def common_pattern(a: dict, b: dict, left: list[int], right: list[int]) -> str:
    """The common part as a pattern text: elements by number and the kinds of the bonds that both have."""
    to = dict(zip(left, right, strict=True))
    kind_b = {frozenset((x["a"], x["b"])): x["kind"] for x in b["bonds"]}
    both = [x["idx"] for x in a["bonds"] if x["a"] in to and x["b"] in to and kind_b.get(frozenset((to[x["a"]], to[x["b"]]))) == x["kind"]]
    return pattern_text(a["atoms"], a["bonds"], left, both)


STATE = "struct<pairs:array<struct<v:int,y:int>>,n_bonds:int,banned:array<struct<v:int,y:int>>,out:array<int>>"
ARROW_PAIRS = pa.list_(pa.struct([("v", pa.int32()), ("y", pa.int32())]))
ARROW_STATE = pa.struct([("pairs", ARROW_PAIRS), ("n_bonds", pa.int32()), ("banned", ARROW_PAIRS), ("out", pa.list_(pa.int32()))])


def packed(s: State) -> dict:
    both = lambda pairs: [{"v": v, "y": y} for v, y in sorted(pairs)]
    return {"pairs": both(s.pairs.items()), "n_bonds": s.n_bonds, "banned": both(s.banned), "out": sorted(s.out)}


def unpacked(s: dict) -> State:
    return State({p["v"]: p["y"] for p in s["pairs"]}, s["n_bonds"], frozenset((p["v"], p["y"]) for p in s["banned"]), frozenset(s["out"]))


def searched(keys: list[str], most: int):
    """Arrow batches of keys, both molecules, the best size so far and a state, or null for the start -> keys, what is found, states left."""
    def run(batches):
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            rows, found = batch.to_pylist(), []
            for r in rows:
                search = Search({"atoms": r["atoms"] or [], "bonds": r["bonds"] or []}, {"atoms": r["b_atoms"] or [], "bonds": r["b_bonds"] or []})
                best, left = search.run([unpacked(r["state"]) if r["state"] else START], ((r["n_bonds"], r["n_atoms"]), {}), most)
                pairs = sorted(best[1].items())
                found.append({"n_bonds": best[0][0], "n_atoms": best[0][1], "left": [v for v, _ in pairs], "right": [y for _, y in pairs], "states": [packed(s) for s in left]})
            out = [pa.array([f[c] for f in found], t) for c, t in (("n_bonds", pa.int32()), ("n_atoms", pa.int32()), ("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32())), ("states", pa.list_(ARROW_STATE)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *out], [*keys, "n_bonds", "n_atoms", "left", "right", "states"])

    return run


@F.arrow_udf(T.StringType())
def mol_common_pattern(a_atoms: pa.Array, a_bonds: pa.Array, b_atoms: pa.Array, b_bonds: pa.Array, left: pa.Array, right: pa.Array) -> pa.Array:
    """The pattern text of a common part; empty if there is none."""
    rows = rows_of(a_atoms, a_bonds, b_atoms, b_bonds, left, right)
    return pa.array([common_pattern({"atoms": aa or [], "bonds": ab or []}, {"atoms": ba or [], "bonds": bb or []}, p or [], q or []) for aa, ab, ba, bb, p, q in rows], pa.string())


@F.arrow_udf(RESULT)
def mol_common(a_atoms: pa.Array, a_bonds: pa.Array, b_atoms: pa.Array, b_bonds: pa.Array) -> pa.Array:
    out = []
    for aa, ab, ba, bb in rows_of(a_atoms, a_bonds, b_atoms, b_bonds):
        out.append(common_part({"atoms": aa or [], "bonds": ab or []}, {"atoms": ba or [], "bonds": bb or []}))
    return pa.array(out, ARROW_RESULT)
