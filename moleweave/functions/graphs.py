"""Columns of graph and valence properties over a molecule's nested atoms, bonds and rings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moleweave.functions.elements import NUMBER, SYMBOLS, VALENCES
from moleweave.functions.molecules import bind, indices, ints, merge_groups, neighbours
from moleweave.functions.smarts import ROTATABLE, matches


def distances(near: list[list[dict]]) -> np.ndarray:
    """Bonds on the shortest path between each two atoms; -1 where there is none.

    A breadth-first search from all atoms at once: the front holds the pairs (from, reached) of the last step, and each
    pair is in it once, so the work is that of a search from every atom, whatever the molecule's shape.
    """
    n = len(near)
    ends = np.array([x["v"] for found in near for x in found], np.int64)
    counts = np.array([len(found) for found in near], np.int64)
    starts = np.cumsum(counts) - counts
    out = np.full(n * n, -1, np.int32)
    front, step = np.arange(n, dtype=np.int64) * (n + 1), 0
    while len(front):
        out[front] = step
        step += 1
        root, v = np.divmod(front, n)
        width = counts[v]
        nth = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        reached = np.repeat(root * n, width) + ends[np.repeat(starts[v], width) + nth]
        front = np.unique(reached[out[reached] < 0])
    return out.reshape(n, n)


@F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def mol_distances(near: pa.Array) -> pa.Array:
    return pa.array([None if x is None else distances(x).tolist() for x in near.to_pylist()], pa.list_(pa.list_(pa.int32())))


@F.arrow_udf(T.LongType())
def mol_distance_sum(near: pa.Array) -> pa.Array:
    """Half the sum of the distance matrix; null where an atom does not reach another, or without atoms."""
    found = (distances(x) if x else np.full((1, 1), -1) for x in near.to_pylist())
    return pa.array([None if (d < 0).any() else int(d.sum()) // 2 for d in found], pa.int64())


def distance_matrix(atoms: Column | None = None) -> Column:
    return mol_distances((F.col("atoms") if atoms is None else atoms)["near"])


def wiener(atoms: Column | None = None) -> Column:
    """The sum of the distances of all pairs of atoms; null for molecules of several parts, where it is not defined."""
    return mol_distance_sum((F.col("atoms") if atoms is None else atoms)["near"])


def ring_systems(spiro: bool = False) -> Column:
    """Fused rings as sorted sets of atoms: rings that share two atoms or more, or with ``spiro`` one."""
    return F.transform(merge_groups(F.col("rings"), 1 if spiro else 2), lambda s: F.array_sort(s))


def n_components() -> Column:
    return F.size(components(F.col("atoms"), F.col("bonds")))


def components(atoms: Column, bonds: Column, keep=None) -> Column:
    """Sets of atoms that bonds join; bonds for which ``keep`` is false count as cut."""
    used = bonds if keep is None else F.filter(bonds, keep)
    return merge_groups(F.concat(F.transform(atoms, lambda a: F.array(a["idx"])), F.transform(used, lambda b: F.array(b["a"], b["b"]))))


def rotatable_groups() -> Column:
    """Groups of rotatable bonds that hang together by atoms, largest first, then by least bond; bonds by index."""
    pairs = F.transform(matches(ROTATABLE), lambda m: F.array_sort(m))
    ends = lambda b: F.array(F.least(b["a"], b["b"]), F.greatest(b["a"], b["b"]))
    bonds = bind(pairs, lambda p: F.filter("bonds", lambda b: F.array_contains(p, ends(b))))
    groups = bind(bonds, lambda bs: F.transform(merge_groups(F.transform(bs, lambda b: F.array(b["a"], b["b"]))), lambda g: F.array_sort(F.transform(F.filter(bs, lambda b: F.array_contains(g, b["a"])), lambda b: b["idx"]))))
    key = lambda g: F.struct(-F.size(g), F.element_at(g, 1))
    return F.array_sort(groups, lambda x, y: F.when(key(x) < key(y), -1).when(key(x) > key(y), 1).otherwise(0))


def longest_rotatable() -> Column:
    return F.coalesce(F.size(F.get(rotatable_groups(), F.lit(0))), F.lit(0))


def core_atoms() -> Column:
    """Atoms left when ends are cut off until none is left: rings and what links them."""
    prune = lambda keep: F.filter(keep, lambda v: F.size(F.array_intersect(neighbours(F.col("atoms"), v), keep)) >= 2)
    state = lambda keep, before: F.struct(keep.alias("keep"), (F.size(keep) == F.size(before)).alias("done"))

    def step(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(bind(prune(s["keep"]), lambda left: state(left, s["keep"])))

    every = indices(F.size("atoms"))
    return F.aggregate(every, F.struct(every.alias("keep"), F.lit(False).alias("done")), step, lambda s: s["keep"])


def conjugated(v: Column, atoms: Column, bonds: Column) -> Column:
    """Whether a neighbour of the atom has a double or aromatic bond."""
    return F.exists(F.get(atoms, v)["near"], lambda x: F.exists(F.get(atoms, x["v"])["near"], lambda y: (y["v"] != v) & F.get(bonds, y["k"])["kind"].isin("DOUBLE", "AROMATIC")))


def hybridizations(atoms: Column | None = None, bonds: Column | None = None) -> Column:
    """Of each atom: S, SP, SP2, SP3, SP3D, SP3D2 or UNSPECIFIED (dummies and transition metals).

    Nitrogen and oxygen that could be SP3 are SP2 next to a double or aromatic bond. ``conjugation`` covers single-bonded atoms.
    """
    atoms, bonds = F.col("atoms") if atoms is None else atoms, F.col("bonds") if bonds is None else bonds

    def one(a: Column) -> Column:
        kinds = F.transform(a["near"], lambda x: F.get(bonds, x["k"])["kind"])
        count = lambda kind: F.size(F.filter(kinds, lambda k: k == kind))
        places = F.size(kinds) + a["n_h"]
        return (
            F.when((a["z"] == 0) | is_transition_metal(a["z"]), "UNSPECIFIED").when(a["z"] == 1, "S").when(places >= 6, "SP3D2").when(places == 5, "SP3D")
            .when((count("TRIPLE") > 0) | ((count("DOUBLE") > 1) & (a["z"] == 6)), "SP").when((count("DOUBLE") > 0) & (places < 4), "SP2").when((count("AROMATIC") > 0), "SP2")
            .when(a["z"].isin(7, 8) & (places < 4) & (a["charge"] <= 0) & conjugated(a["idx"], atoms, bonds), "SP2").otherwise("SP3")
        )

    return F.transform(atoms, one)


def unpaired_electrons() -> Column:
    """Of each atom: what its bonds and hydrogens leave open of the least usual valence that fits, if it is written in brackets."""
    used = lambda a: a["explicit_valence"] + F.when(a["bracket"], 0).otherwise(a["n_h"])
    fits = lambda a: F.array_min(F.filter(F.try_element_at(valence_table(), a["z"] - a["charge"]), lambda v: v >= used(a)))
    return F.transform("atoms", lambda a: F.when(a["bracket"] & ~a["aromatic"], F.coalesce(fits(a) - used(a), F.lit(0))).otherwise(0))


def conjugated_bonds() -> Column:
    """Bonds, by index, that are aromatic or, with a single bond to another multiple one at either end, part of a row of such."""
    many = lambda v, but: F.exists(F.get(F.col("atoms"), v)["near"], lambda x: (x["k"] != but) & F.get(F.col("bonds"), x["k"])["kind"].isin("DOUBLE", "TRIPLE", "AROMATIC"))
    middle = lambda b: (b["kind"] == "SINGLE") & many(b["a"], b["idx"]) & many(b["b"], b["idx"])
    beside = lambda b, v: F.exists(F.get(F.col("atoms"), v)["near"], lambda x: middle(F.get(F.col("bonds"), x["k"])))
    end = lambda b: b["kind"].isin("DOUBLE", "TRIPLE") & (beside(b, b["a"]) | beside(b, b["b"]))
    return F.transform(F.filter("bonds", lambda b: (b["kind"] == "AROMATIC") | middle(b) | end(b)), lambda b: b["idx"])


def is_transition_metal(z: Column) -> Column:
    """Numbers 22 to 29, 40 to 47 and 72 to 79; the first and last columns of the block are not counted."""
    return z.between(22, 29) | z.between(40, 47) | z.between(72, 79)


def valence_table() -> Column:
    """Usual valences by atomic number, a map of fixed size."""
    return F.create_map(*[x for s, v in VALENCES.items() for x in (F.lit(NUMBER[s]), ints(*v))])


def most_valence(z: Column, charge: Column) -> Column:
    """The largest usual valence; a charged atom has that of the uncharged element with as many electrons. Null: no limit."""
    return F.array_max(F.try_element_at(valence_table(), z - charge))


def counted_valence(a: Column, total: Column) -> Column:
    """An atom's valence from its sum of bond orders, as the parser counts it: see :func:`moleweave.functions.smiles.valence_of`."""
    over = total - default_valence(a["z"] - a["charge"])
    return F.when(a["aromatic"] & (over > 0) & (over <= 1.5), default_valence(a["z"] - a["charge"])).otherwise(F.floor(total + 0.5).cast("int"))


def default_valence(z: Column) -> Column:
    return F.element_at(F.try_element_at(valence_table(), z), 1)


def valence_problems(atoms: Column | None = None) -> Column:
    """(kind, atoms, message) of atoms with more bonds than their element allows."""
    atoms = F.col("atoms") if atoms is None else atoms
    bad = F.filter(atoms, lambda a: F.coalesce(a["explicit_valence"] > most_valence(a["z"], a["charge"]), F.lit(False)))
    return F.transform(bad, lambda a: F.struct(
        F.lit("valence").alias("kind"), F.array(a["idx"]).alias("atoms"),
        F.format_string("valence %d of atom %d, %s, is too large", a["explicit_valence"], a["idx"], a["symbol"]).alias("message"),
    ))


def formula(atoms: Column | None = None) -> Column:
    """Counts of the elements: carbon, hydrogen, then by symbol; without carbon all by symbol; charge at the end."""
    atoms = F.col("atoms") if atoms is None else atoms
    h = F.aggregate(atoms, F.lit(0), lambda n, a: n + a["n_h"] + F.when(a["z"] == 1, 1).otherwise(0))
    charge = F.aggregate(atoms, F.lit(0), lambda n, a: n + a["charge"])
    count = lambda symbol: F.when(symbol == "H", h).otherwise(F.size(F.filter(atoms, lambda a: a["symbol"] == symbol)))
    symbols = F.array_distinct(F.concat(F.transform(F.filter(atoms, lambda a: (a["z"] > 0)), lambda a: a["symbol"]), F.when(h > 0, F.array(F.lit("H"))).otherwise(F.array().cast("array<string>"))))
    carbon = F.exists(atoms, lambda a: a["z"] == 6)
    key = lambda s: F.when(carbon & (s == "C"), F.lit("0")).when(carbon & (s == "H"), F.lit("1")).otherwise(s)
    ordered = F.transform(F.array_sort(F.transform(symbols, lambda s: F.struct(key(s).alias("key"), s.alias("s")))), lambda x: x["s"])
    text = F.array_join(F.transform(ordered, lambda s: F.concat(s, F.when(count(s) > 1, count(s).cast("string")).otherwise(""))), "")
    sign = F.when(charge > 0, F.concat(F.lit("+"), F.when(charge > 1, charge.cast("string")).otherwise(""))).when(charge < 0, F.concat(F.lit("-"), F.when(charge < -1, (-charge).cast("string")).otherwise(""))).otherwise("")
    return F.concat(text, sign)


def element_symbol(z: Column) -> Column:
    return F.get(F.array(F.lit("*"), *map(F.lit, SYMBOLS)), z)
