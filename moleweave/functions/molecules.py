"""Molecules as nested columns: their types, the parser as an Arrow function, and small column helpers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from moleweave.functions.slices import ROWS
from moleweave.functions.smiles import molecule

I, S, B = pa.int32(), pa.string(), pa.bool_()
ARROW_ATOM = pa.struct([
    ("idx", I), ("symbol", S), ("z", I), ("charge", I), ("n_h", I), ("isotope", I), ("aromatic", B), ("map_num", I), ("chiral", S), ("explicit_valence", I), ("bracket", B),
    ("around", pa.list_(I)), ("near", pa.list_(pa.struct([("v", I), ("k", I)]))),
])
ARROW_BOND = pa.struct([("idx", I), ("a", I), ("b", I), ("order", pa.float64()), ("kind", S), ("aromatic", B), ("in_ring", B), ("stereo", S)])
MOLECULE = pa.struct([("parse_ok", B), ("error", S), ("atoms", pa.list_(ARROW_ATOM)), ("bonds", pa.list_(ARROW_BOND)), ("rings", pa.list_(pa.list_(I)))])
MOLECULE_TYPE = from_arrow_type(MOLECULE)


def parsed(smiles: pa.Array, sanitize: bool) -> pa.Array:
    """The molecules of texts, few of them as Python objects at once."""
    some = [pa.array([molecule(x, sanitize) for x in smiles.slice(at, ROWS).to_pylist()], MOLECULE) for at in range(0, len(smiles), ROWS)]
    return pa.concat_arrays(some) if some else pa.array([], MOLECULE)


@F.arrow_udf(MOLECULE_TYPE)
def mol_parse(smiles: pa.Array) -> pa.Array:
    """SMILES to a molecule, with aromatic rings found; texts that cannot be read give parse_ok = false and the error."""
    return parsed(smiles, True)


@F.arrow_udf(MOLECULE_TYPE)
def mol_parse_raw(smiles: pa.Array) -> pa.Array:
    """SMILES to a molecule as written: no aromaticity is looked for."""
    return parsed(smiles, False)


def bind(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), then), 1)


def ints(*values: int) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<int>")


def indices(n: Column) -> Column:
    """0 to n - 1; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(ints())


def neighbours(atoms: Column, v: Column) -> Column:
    return F.transform(F.get(atoms, v)["near"], lambda x: x["v"])


def merge_groups(groups: Column, least: int = 1) -> Column:
    """Fold sets into systems: each set takes in the systems with which it has ``least`` members in common.

    The set grows while it passes the systems in turn, and systems that it has passed are not tried again, so two
    contacts of fewer members may add up. With ``least`` 1 the systems are the connected components.
    """

    def step(systems: Column, new: Column) -> Column:
        def take(state: Column, system: Column) -> Column:
            joined = F.size(F.array_intersect(state["set"], system)) >= least
            return F.when(joined, F.struct(F.array_union(state["set"], system).alias("set"), state["rest"].alias("rest"))).otherwise(
                F.struct(state["set"].alias("set"), F.array_append(state["rest"], system).alias("rest"))
            )

        start = F.struct(new.alias("set"), F.array().cast("array<array<int>>").alias("rest"))
        return F.aggregate(systems, start, take, lambda s: F.array_append(s["rest"], s["set"]))

    return F.aggregate(groups, F.array().cast("array<array<int>>"), step)
