"""Files with a molecule on each line, text first and then a name, read and written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moleweave.operators.hashes import with_hash


def split_line(df: DataFrame) -> DataFrame:
    """(value) -> (smiles, name): the first word and the rest; empty lines and lines that begin with # are left out."""
    line = F.trim("value")
    parts = F.split(line, r"\s+", 2)
    return df.where((line != "") & ~line.startswith("#")).select(parts[0].alias("smiles"), F.get(parts, F.lit(1)).alias("name"))


def read_smiles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(smiles, name) of text files, also compressed ones and folders of them."""
    return split_line(spark.read.text(path))


def read_smiles_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The same as a stream of the files that come to a folder."""
    return split_line(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))


def write_smiles(mols: DataFrame, path: str, name: str = "name") -> None:
    """Canonical texts and names, a line for each molecule that could be read."""
    texts = with_hash(mols.where("parse_ok"), "canonical_smiles")
    texts.select(F.concat_ws(" ", "canonical_smiles", F.col(name).cast("string"))).write.text(path)


def write_table(mols: DataFrame, path: str) -> None:
    """Molecule rows as Parquet: their element numbers, charges and sizes are then ordinary columns that filters reach."""
    sized = mols.withColumn("n_atoms", F.size("atoms")).withColumn("elements", F.array_sort(F.array_distinct(F.transform("atoms", lambda a: a["z"]))))
    sized.write.parquet(path)

