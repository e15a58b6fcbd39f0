"""Names for SQL: after :func:`register`, molecules can be parsed, measured and written in queries.

``inline(mol_parse(s).atoms)`` gives a row for each atom; ``mol_atoms(s)`` and ``mol_bonds(s)`` are table functions that do
so with fewer columns. ``mol_hash(s, name)`` has the hashes that are written from the whole molecule. ``mol_matches(s,
smarts)`` and ``mol_match(s, smarts)`` take a pattern's text; one pattern over many molecules is faster as a column, of
which :func:`register_pattern` makes a view.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moleweave.functions.alignment import mol_common
from moleweave.functions.chemistry import mol_centres, mol_double_bonds, mol_unpaired
from moleweave.functions.graphs import mol_distance_sum, mol_distances
from moleweave.functions.molecules import mol_parse, mol_parse_raw
from moleweave.functions.smarts import matches, mol_match, mol_matches
from moleweave.functions.smiles import molecule
from moleweave.functions.writer import mol_attach, mol_join, mol_write, write

def hash_of(text: str | None, name: str | None) -> str | None:
    m = molecule(text)
    if not m["parse_ok"]:
        return None
    if name == "canonical_smiles":
        return write(m["atoms"], m["bonds"])
    if name in ("element_graph", "anonymous_graph"):
        none = {"charge": 0, "aromatic": False, "isotope": None, "map_num": None, "n_h": 0, "chiral": ""} | ({"symbol": "*", "z": 0} if name == "anonymous_graph" else {})
        return write([a | none for a in m["atoms"]], [b | {"kind": "SINGLE", "order": 1.0} for b in m["bonds"]])
    if name == "atom_bond_counts":
        return f"{len(m['atoms'])},{len(m['bonds'])}"
    if name == "net_charge":
        return str(sum(a["charge"] for a in m["atoms"]))
    raise ValueError(f"hash {name}")


@F.arrow_udf(T.StringType())
def mol_hash(smiles: pa.Array, name: pa.Array) -> pa.Array:
    return pa.array([hash_of(s, n) for s, n in zip(smiles.to_pylist(), name.to_pylist(), strict=True)], pa.string())


@F.udtf(returnType="idx int, symbol string, z int, charge int, n_h int, aromatic boolean")
class MolAtoms:
    """A row for each atom of a text; none of a text that cannot be read."""

    def eval(self, smiles: str) -> Iterator[tuple]:
        for a in molecule(smiles)["atoms"]:
            yield a["idx"], a["symbol"], a["z"], a["charge"], a["n_h"], a["aromatic"]


@F.udtf(returnType="idx int, a int, b int, kind string, in_ring boolean")
class MolBonds:
    """A row for each bond of a text; none of a text that cannot be read."""

    def eval(self, smiles: str) -> Iterator[tuple]:
        for b in molecule(smiles)["bonds"]:
            yield b["idx"], b["a"], b["b"], b["kind"], b["in_ring"]


def register_pattern(mols: DataFrame, name: str, smarts: str) -> None:
    """A view ``name`` of the molecules with column ``matches``, for queries that ask for a pattern."""
    mols.withColumn("matches", matches(smarts)).createOrReplaceTempView(name)


FUNCTIONS = {
    "mol_parse": mol_parse, "mol_parse_raw": mol_parse_raw, "mol_write": mol_write, "mol_join": mol_join, "mol_attach": mol_attach, "mol_wiener": mol_distance_sum,
    "mol_distances": mol_distances, "mol_unpaired": mol_unpaired, "mol_centres": mol_centres, "mol_double_bonds": mol_double_bonds, "mol_common": mol_common, "mol_hash": mol_hash, "mol_match": mol_match, "mol_matches": mol_matches,
}
TABLES = {"mol_atoms": MolAtoms, "mol_bonds": MolBonds}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
    for name, table in TABLES.items():
        spark.udtf.register(name, table)
