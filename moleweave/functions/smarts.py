"""Substructure patterns: a SMARTS text becomes a Column over a molecule's nested atoms, bonds and rings.

The pattern is read once on the driver. Matching extends arrays of partial matches by one query atom at a time with
Spark's array functions, so it needs neither a shuffle nor Python workers. Patterns that come as rows of a table are read
where they are used: the same tests are then asked of the rows of a parsed molecule, see :class:`Rows`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moleweave.functions.elements import NUMBER
from moleweave.functions.molecules import bind, ints
from moleweave.functions.slices import rows_of
from moleweave.functions.smiles import molecule

PLAIN = re.compile(r"Br|Cl|[BCNOPSFI]|[bcnops]|\*|[aA]")
PRIMITIVE = re.compile(r"([A-Z][a-z]|[BCFIKNOPSUVWY]|se|as|te|[bcnops])|#(\d+)|r\{(\d*)-(\d*)\}|([HhDXvRrx])(\d*)|(\++|-+)(\d*)|@+|[*aA]|(\d+)")
BONDS = {"-": "SINGLE", "=": "DOUBLE", "#": "TRIPLE", ":": "AROMATIC", "/": "SINGLE", "\\": "SINGLE"}
#: Tests of an atom or bond: columns of a column's fields, or truths of a row's.
Test = Callable


class Mol(NamedTuple):
    """A molecule as columns, and what tests ask of it."""

    atoms: Column
    bonds: Column
    rings: Column

    def true(self) -> Column:
        return F.lit(True)

    def negated(self, found: Column) -> Column:
        return ~found

    def degree(self, a: Column) -> Column:
        return F.size(a["near"])

    def ring_bonds(self, a: Column) -> Column:
        return F.size(F.filter(a["near"], lambda x: F.get(self.bonds, x["k"])["in_ring"]))

    def n_rings(self, a: Column) -> Column:
        return F.size(self.sizes(a))

    def smallest(self, a: Column) -> Column:
        """The size of the smallest ring of the atom; -1 outside rings."""
        return F.coalesce(F.array_min(self.sizes(a)), F.lit(-1))

    def sizes(self, a: Column) -> Column:
        return F.transform(F.filter(self.rings, lambda r: F.array_contains(r, a["idx"])), lambda r: F.size(r))

    def valence(self, a: Column) -> Column:
        return a["explicit_valence"] + F.when(a["bracket"], 0).otherwise(a["n_h"])

    def isotope(self, a: Column) -> Column:
        return F.coalesce(a["isotope"], F.lit(0))

    def kind_in(self, b: Column, *kinds: str) -> Column:
        return b["kind"].isin(*kinds)

    def begins(self, p: Pattern, a: Column) -> Column:
        """Whether a match of the pattern begins at the atom."""
        return F.size(expand(p, self, F.array(a["idx"]))) > 0


class Rows:
    """A parsed molecule, asked the same."""

    def __init__(self, m: dict) -> None:
        self.atoms, self.bonds = m["atoms"], m["bonds"]
        self.sizes: dict[int, list[int]] = {}
        for ring in m["rings"]:
            for v in ring:
                self.sizes.setdefault(v, []).append(len(ring))

    def true(self) -> bool:
        return True

    def negated(self, found: bool) -> bool:
        return not found

    def degree(self, a: dict) -> int:
        return len(a["near"])

    def ring_bonds(self, a: dict) -> int:
        return sum(self.bonds[x["k"]]["in_ring"] for x in a["near"])

    def n_rings(self, a: dict) -> int:
        return len(self.sizes.get(a["idx"], ()))

    def smallest(self, a: dict) -> int:
        return min(self.sizes.get(a["idx"], ()), default=-1)

    def valence(self, a: dict) -> int:
        return a["explicit_valence"] + (0 if a["bracket"] else a["n_h"])

    def isotope(self, a: dict) -> int:
        return a["isotope"] or 0

    def kind_in(self, b: dict, *kinds: str) -> bool:
        return b["kind"] in kinds

    def begins(self, p: Pattern, a: dict) -> bool:
        return next(found(p, self, [a]), None) is not None


class Pattern(NamedTuple):
    atoms: list[Test]
    bonds: list[tuple[int, int, Test]]
    maps: list[int | None]
    #: Atomic number of each atom that has just one, else None.
    numbers: list[int | None]


def mol(prefix: str = "") -> Mol:
    return Mol(*(F.col(prefix + c) for c in ("atoms", "bonds", "rings")))


def element(symbol: str) -> tuple[Test, int | None]:
    if symbol == "*":
        return lambda a, m: m.true(), None
    if symbol in ("a", "A"):
        return (lambda a, m: a["aromatic"] == (symbol == "a")), None
    if symbol.capitalize() not in NUMBER:
        raise ValueError(f"element {symbol}")
    z = NUMBER[symbol.capitalize()]
    return (lambda a, m: (a["z"] == z) & (a["aromatic"] == symbol.islower())), z


def counted(kind: str, digits: str) -> Test:
    """H hydrogens, D neighbours, X both, v valence, R rings, r size of the smallest ring, x ring bonds."""
    n = int(digits) if digits else None
    one = 1 if n is None else n
    if kind in "Hh":
        return lambda a, m: a["n_h"] == one
    if kind == "D":
        return lambda a, m: m.degree(a) == one
    if kind == "X":
        return lambda a, m: m.degree(a) + a["n_h"] == one
    if kind == "v":
        return lambda a, m: m.valence(a) == one
    if kind == "x":
        return (lambda a, m: m.ring_bonds(a) > 0) if n is None else lambda a, m: m.ring_bonds(a) == n
    if n is None:
        return lambda a, m: m.n_rings(a) > 0
    if kind == "R" or n == 0:
        return lambda a, m: m.n_rings(a) == n
    return lambda a, m: m.smallest(a) == n


def both(tests: list[Test], join: Callable) -> Test:
    return tests[0] if len(tests) == 1 else lambda a, m: reduce(join, [t(a, m) for t in tests])


def negated(test: Test) -> Test:
    return lambda a, m: m.negated(test(a, m))


def split_top(text: str, sign: str) -> list[str]:
    """Split outside parentheses and braces."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "({") - (c in ")}")
        if c == sign and not depth:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def bracket(text: str) -> tuple[Test, int | None, int | None]:
    """The content of square brackets: its test, map number, and the one atomic number that it allows, if any."""
    found = re.search(r":(\d+)$", text)
    number = int(found[1]) if found else None
    text = text[: found.start()] if found else text
    fixed: set[int | None] = set()

    def primitives(part: str) -> Test:
        tests, at = [], 0
        while at < len(part):
            start = at
            while at < len(part) and part[at] in "!&":
                at += 1
            no = part[start:at].count("!") % 2 == 1
            if part.startswith("$(", at):
                depth, end = 0, at + 1
                while True:
                    depth += (part[end] == "(") - (part[end] == ")")
                    end += 1
                    if not depth:
                        break
                inner = pattern(part[at + 2:end - 1])
                test, z = (lambda a, m, inner=inner: m.begins(inner, a)), None
                at = end
            else:
                m = PRIMITIVE.match(part, at)
                if not m:
                    raise ValueError(f"primitive {part[at:]}")
                symbol, number_, low, high, kind, digits, sign, amount, isotope = m.groups()
                if symbol and symbol.capitalize() not in NUMBER:
                    symbol = symbol[0]
                at, z = at + (len(symbol) if symbol else len(m[0])), None
                if symbol or part == "H" or m[0] in ("*", "a", "A"):
                    test, z = element(symbol or m[0])
                elif number_:
                    z = int(number_)
                    test = lambda a, mol_, z=z: a["z"] == z
                elif low is not None:
                    low, high = int(low or 0), int(high or 10**6)
                    test = lambda a, mol_, low=low, high=high: (mol_.smallest(a) >= max(low, 0)) & (mol_.smallest(a) <= high)
                elif kind:
                    test = counted(kind, digits)
                elif sign:
                    charge = (1 if sign[0] == "+" else -1) * (int(amount) if amount else len(sign))
                    test = lambda a, mol_, c=charge: a["charge"] == c
                elif isotope:
                    test = lambda a, mol_, i=int(isotope): mol_.isotope(a) == i
                else:
                    test = lambda a, mol_: mol_.true()  # noqa: E731  chirality is not compared
            tests.append(negated(test) if no else test)
            if z is not None and not no:
                fixed.add(z)
        return both(tests, lambda x, y: x & y)

    one = "," not in text
    test = both([both([primitives(p) for p in split_top(part, ",")], lambda x, y: x | y) for part in split_top(text, ";")], lambda x, y: x & y)
    return test, number, next(iter(fixed)) if one and len(fixed) == 1 else None


def bond_test(text: str) -> Test:
    """A bond between two query atoms; without a sign it is single or aromatic."""
    if not text:
        return lambda b, m: m.kind_in(b, "SINGLE", "AROMATIC", "DATIVE")

    def one(sign: str) -> Test:
        no, sign = sign.count("!") % 2 == 1, sign.replace("!", "")
        test = (lambda b, m: m.true()) if sign == "~" else (lambda b, m: b["in_ring"]) if sign == "@" else lambda b, m: b["kind"] == BONDS[sign]
        return negated(test) if no else test

    each = lambda part: both([one(x) for x in re.findall(r"!*[-=#:~@/\\]", part)], lambda x, y: x & y)
    return both([both([each(p) for p in part.split(",")], lambda x, y: x | y) for part in text.split(";")], lambda x, y: x & y)


def pattern(text: str) -> Pattern:
    """Read a SMARTS text; raises ValueError for one that is not understood."""
    out = Pattern([], [], [], [])
    stack: list[int | None] = []
    rings: dict[str, tuple[int, str]] = {}
    last, sign, at = None, "", 0
    while at < len(text):
        c = text[at]
        if c == "(":
            stack.append(last)
        elif c == ")":
            last = stack.pop()
        elif c == ".":
            last, sign = None, ""
        elif c in "-=#:~@/\\!&,;":
            end = at
            while text[end] in "-=#:~@/\\!&,;":
                end += 1
            sign, at = text[at:end].replace("&", ""), end - 1
        elif c.isdigit() or c == "%":
            label = text[at + 1:at + 3] if c == "%" else c
            at += 2 * (c == "%")
            if label in rings:
                other, first = rings.pop(label)
                out.bonds.append((other, last, bond_test(sign or first)))
            else:
                rings[label] = last, sign
            sign = ""
        else:
            if c == "[":
                depth, end = 0, at
                while True:
                    depth += (text[end] == "[") - (text[end] == "]")
                    end += 1
                    if not depth:
                        break
                test, number, z = bracket(text[at + 1:end - 1])
                at = end - 1
            else:
                m = PLAIN.match(text, at)
                if not m:
                    raise ValueError(f"character {at} of {text}")
                (test, z), number = element(m[0]), None
                at = m.end() - 1
            out.atoms.append(test)
            out.maps.append(number)
            out.numbers.append(z)
            if last is not None:
                out.bonds.append((last, len(out.atoms) - 1, bond_test(sign)))
            last, sign = len(out.atoms) - 1, ""
        at += 1
    if stack or rings or not out.atoms:
        raise ValueError(f"unfinished pattern {text}")
    return out


def extension(p: Pattern, m: Mol, q: int) -> Callable[[Column], Column]:
    """A partial match -> the matches that have query atom ``q`` too."""
    back = [(min(a, b), test) for a, b, test in p.bonds if max(a, b) == q]

    def closes(done: Column, v: Column, other: int, test: Test) -> Column:
        return F.exists(F.get(m.atoms, v)["near"], lambda y: (y["v"] == F.get(done, F.lit(other))) & test(F.get(m.bonds, y["k"]), m))

    def extend(done: Column) -> Column:
        free = lambda v: ~F.array_contains(done, v) & p.atoms[q](F.get(m.atoms, v), m)
        if not back:
            return F.transform(F.filter(m.atoms, lambda a: free(a["idx"])), lambda a: F.array_append(done, a["idx"]))
        (parent, test), *closing = back
        fits = lambda x: reduce(lambda y, z: y & z, [test(F.get(m.bonds, x["k"]), m) & free(x["v"]), *(closes(done, x["v"], *c) for c in closing)])
        return F.transform(F.filter(F.get(m.atoms, F.get(done, F.lit(parent)))["near"], fits), lambda x: F.array_append(done, x["v"]))

    return extend


def expand(p: Pattern, m: Mol, starts: Column | None = None) -> Column:
    """All matches, each an array of atom indices in the order of the query's atoms."""
    first = m.atoms if starts is None else F.transform(starts, lambda v: F.get(m.atoms, v))
    found = F.transform(F.filter(first, lambda a: p.atoms[0](a, m)), lambda a: F.array(a["idx"]))
    for q in range(1, len(p.atoms)):
        found = F.flatten(F.transform(found, extension(p, m, q)))
    return found


def screen(p: Pattern, m: Mol) -> Column:
    """Whether a molecule has as many atoms of each element as the pattern asks for, which is cheap to find."""
    has = lambda z: F.size(F.filter(m.atoms, lambda a: a["z"] == z))
    need = Counter(z for z in p.numbers if z)
    return reduce(lambda x, y: x & y, [F.size(m.atoms) >= len(p.atoms), *(has(z) >= n for z, n in need.items())])


def matches(smarts: str, m: Mol | None = None, uniquify: bool = True) -> Column:
    """Matches of the pattern; with ``uniquify`` the first of those that cover the same atoms."""
    p, m = pattern(smarts), m or mol()
    found = expand(p, m)
    if uniquify and len(p.atoms) > 1:
        sets = lambda all_: bind(F.transform(all_, lambda x: F.array_sort(x)), lambda s: F.filter(all_, lambda x, i: F.array_position(s, F.array_sort(x)) == i + 1))
        found = bind(found, sets)
    return F.when(screen(p, m), found).otherwise(F.array().cast("array<array<int>>"))


def found(p: Pattern, m: Rows, starts: list[dict] | None = None) -> Iterator[list[int]]:
    """The matches of :func:`expand`, in its order, over the rows of one molecule."""
    back = [[] for _ in p.atoms]
    for a, b, test in p.bonds:
        back[max(a, b)].append((min(a, b), test))

    def choices(done: list[int]) -> Iterator[int]:
        q = len(done)
        if not back[q]:
            yield from (a["idx"] for a in (m.atoms if q or starts is None else starts) if a["idx"] not in done and p.atoms[q](a, m))
            return
        (parent, test), *closing = back[q]
        for x in m.atoms[done[parent]]["near"]:
            v = x["v"]
            if v not in done and test(m.bonds[x["k"]], m) and p.atoms[q](m.atoms[v], m):
                if all(any(y["v"] == done[other] and t(m.bonds[y["k"]], m) for y in m.atoms[v]["near"]) for other, t in closing):
                    yield v

    done: list[int] = []
    stack = [choices(done)]
    while stack:
        v = next(stack[-1], None)
        if v is None:
            stack.pop()
            if done:
                done.pop()
        elif len(stack) == len(p.atoms):
            yield [*done, v]
        else:
            done.append(v)
            stack.append(choices(done))


def row_matches(p: Pattern, m: dict, uniquify: bool = True) -> list[list[int]]:
    """The matches of :func:`matches` in one parsed molecule."""
    rows, seen, out = Rows(m), set(), []
    for match in found(p, rows):
        key = tuple(sorted(match))
        if not uniquify or len(p.atoms) == 1 or key not in seen:
            seen.add(key)
            out.append(match)
    return out


def needs(p: Pattern) -> list[str]:
    """What a molecule has if the pattern matches: elements and pairs of bonded elements, where the pattern names them."""
    pairs = {tuple(sorted((p.numbers[a], p.numbers[b]))) for a, b, _ in p.bonds if p.numbers[a] and p.numbers[b]}
    return sorted({str(z) for z in p.numbers if z} | {f"{a}-{b}" for a, b in pairs})


def query_bonds(smarts: str) -> Column:
    """The pairs of query atoms that the pattern bonds, in the order of the text."""
    return F.array(*[ints(a, b) for a, b, _ in pattern(smarts).bonds])


#: Single bonds outside rings whose ends have other neighbours and no triple bond.
ROTATABLE = "[!$(*#*)&!D1]-&!@[!$(*#*)&!D1]"

#: Patterns and molecules that a task keeps read.
KEPT = 4096


@lru_cache(maxsize=KEPT)
def read_pattern(text: str | None) -> tuple[Pattern | None, str | None]:
    """A pattern, or why the text is none."""
    try:
        return pattern(text or ""), None
    except (ValueError, IndexError, KeyError, TypeError) as problem:
        return None, str(problem) or "pattern"


@lru_cache(maxsize=KEPT)
def read_molecule(text: str | None) -> dict:
    return molecule(text)


MATCHES = T.ArrayType(T.ArrayType(T.IntegerType()))


def texts_matches(smiles: pa.Array, smarts: pa.Array) -> Iterator[list[list[int]] | None]:
    for text, asked in zip(smiles.to_pylist(), smarts.to_pylist(), strict=True):
        p, m = read_pattern(asked)[0], read_molecule(text)
        yield row_matches(p, m) if p and m["parse_ok"] else None


@F.arrow_udf(MATCHES)
def mol_matches(smiles: pa.Array, smarts: pa.Array) -> pa.Array:
    """The matches of a pattern's text in a molecule's text; null if either cannot be read."""
    return pa.array(list(texts_matches(smiles, smarts)), pa.list_(pa.list_(pa.int32())))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def mol_match(smiles: pa.Array, smarts: pa.Array) -> pa.Array:
    """The first match of a pattern's text in a molecule's text; null if there is none or either cannot be read."""
    return pa.array([m[0] if m else None for m in texts_matches(smiles, smarts)], pa.list_(pa.int32()))


@F.arrow_udf(T.StructType([T.StructField("error", T.StringType()), T.StructField("needs", T.ArrayType(T.StringType()))]))
def pattern_needs(smarts: pa.Array) -> pa.Array:
    """Why a text is no pattern, null if it is one, and what a molecule has if it matches."""
    found = [read_pattern(x) for x in smarts.to_pylist()]
    return pa.array([{"error": error, "needs": needs(p) if p else []} for p, error in found], pa.struct([("error", pa.string()), ("needs", pa.list_(pa.string()))]))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("matches", MATCHES)])))
def mol_matches_each(atoms: pa.Array, bonds: pa.Array, rings: pa.Array, patterns: pa.Array) -> pa.Array:
    """The matches of each pattern of a list that matches, by its place in the list."""
    out = []
    for a, b, r, texts in rows_of(atoms, bonds, rings, patterns):
        m = {"atoms": a or [], "bonds": b or [], "rings": r or []}
        hits = ((k, row_matches(p, m)) for k, p in enumerate(read_pattern(t)[0] for t in texts) if p)
        out.append([{"at": k, "matches": x} for k, x in hits if x])
    return pa.array(out, pa.list_(pa.struct([("at", pa.int32()), ("matches", pa.list_(pa.list_(pa.int32())))])))
