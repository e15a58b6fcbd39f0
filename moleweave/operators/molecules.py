"""From texts to molecule rows, and the normalised tables of their atoms, bonds and rings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moleweave.functions.molecules import mol_parse, mol_parse_raw

FIELDS = ("parse_ok", "error", "atoms", "bonds", "rings")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly if they come in fewer partitions than there are cores: texts are small and the work on them is large.

    Tables of more partitions than cores are left as they are, so large inputs are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def molecules(df: DataFrame, smiles: str | Column = "smiles", sanitize: bool = True) -> DataFrame:
    """``df`` with parse_ok, error, atoms, bonds and rings; bad or null texts have parse_ok = false and no atoms.

    Each text is parsed once, whatever later steps ask of it: the explode keeps the call from being copied into every
    expression that reads one of its fields.
    """
    smiles = F.col(smiles) if isinstance(smiles, str) else smiles
    df = df.withColumn("__text", smiles).drop(*FIELDS)
    rest = [c for c in df.columns if c != "__text"]
    return df.withColumn("__m", F.explode(F.array((mol_parse if sanitize else mol_parse_raw)("__text")))).select(*rest, "__m.*")


def shared_dir(spark: SparkSession) -> str:
    """The session's folder below ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage at a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once, as attributes that Python functions can take: array functions are not copied into their arguments."""
    fields = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.drop(*columns).withColumn("__stage", F.explode(F.array(fields))).select(*[c for c in df.columns if c not in columns], "__stage.*")


#: Results of at most so many bytes, as JSON, are broadcast by :func:`each_text`; others are repeated under so many salts.
RESULT_BYTES, SALTS = 4 << 20, 16
#: Distinct texts that :func:`each_text` deals to a task at least, if there are fewer than make use of all partitions.
TEXTS = 4


def each_text(df: DataFrame, texts: list[str], run: Callable[[DataFrame], DataFrame], limit: int = RESULT_BYTES) -> DataFrame:
    """``df`` joined with ``run`` of the distinct values of its columns ``texts``: what recurs is read and searched once.

    ``run`` takes a table of these columns and gives rows with them, one, several or none for each, and further columns.
    Rows of ``df`` with the same texts get the same; nulls are equal. Both tables are materialised. Up to ``limit`` counted
    bytes the results are broadcast, beyond it both sides are salted, so that a frequent text is no hot key.
    """
    asked = cut(df.select(*texts).distinct())
    n = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), asked.count() // TEXTS + 1)
    done = cut(run(asked.repartition(n)))
    size = done.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))).first()[0] or 0
    done = done.withColumnsRenamed({c: f"__of_{c}" for c in texts})
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in texts]
    if size <= limit:
        done = F.broadcast(done)
    else:
        df = df.withColumn("__slot", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
        done = done.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        same.append(F.col("__slot") == F.col("__salt"))
    return df.join(done, same).drop("__slot", "__salt", *[f"__of_{c}" for c in texts])


def atoms(mols: DataFrame, *keys: str) -> DataFrame:
    """A row for each atom."""
    return mols.select(*keys, F.explode("atoms").alias("atom")).select(*keys, "atom.*")


def bonds(mols: DataFrame, *keys: str) -> DataFrame:
    """A row for each bond, with its ends, kind and stereo mark."""
    return mols.select(*keys, F.explode("bonds").alias("bond")).select(*keys, "bond.*")


def ring_atoms(mols: DataFrame, *keys: str) -> DataFrame:
    """A row for each ring and atom in it: ring_idx, atom_idx."""
    return mols.select(*keys, F.posexplode("rings").alias("ring_idx", "ring")).select(*keys, "ring_idx", F.explode("ring").alias("atom_idx"))


def bond_between(pairs: DataFrame, bond_rows: DataFrame, *keys: str) -> DataFrame:
    """``pairs`` (keys, x, y) with bond_idx of the bond between the two atoms, whichever way it was written; null if none."""
    side = lambda df, a, b: df.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b))
    # There are many more bonds than the size of their molecules' table lets Spark expect, so they are not to be broadcast.
    found = side(bond_rows, "a", "b").select(*keys, "lo", "hi", F.col("idx").alias("bond_idx")).hint("merge")
    return side(pairs, "x", "y").join(found, [*keys, "lo", "hi"], "left").drop("lo", "hi")


def with_atom_map(mols: DataFrame, offset: int = 0) -> DataFrame:
    """Number the atoms by index plus ``offset``; number 0 is no number."""
    number = lambda a: F.when(a["idx"] + offset > 0, a["idx"] + offset)
    return mols.withColumn("atoms", F.transform("atoms", lambda a: a.withField("map_num", number(a))))


def atom_labels(mols: DataFrame) -> DataFrame:
    """Add labels: each atom's symbol, without hydrogens."""
    return mols.withColumn("labels", F.transform("atoms", lambda a: a["symbol"]))


def highlight_regions(mols: DataFrame, *keys: str) -> DataFrame:
    """(keys, region, atom_idxs, bond_idxs): the aromatic atoms and bonds of each molecule, and the others."""
    part = lambda flag: F.struct(
        F.lit("aromatic" if flag else "other").alias("region"),
        F.transform(F.filter("atoms", lambda a: a["aromatic"] == flag), lambda a: a["idx"]).alias("atom_idxs"),
        F.transform(F.filter("bonds", lambda b: b["aromatic"] == flag), lambda b: b["idx"]).alias("bond_idxs"),
    )
    return mols.select(*keys, F.explode(F.array(part(True), part(False))).alias("r")).select(*keys, "r.*")
