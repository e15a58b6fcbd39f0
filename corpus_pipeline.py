"""The training-data pipeline: rules, near-duplicates, benchmark passages, source mix and packed token ids.

Each stage takes the documents that the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moleweave.llm.common import fresh_dir, table
from moleweave.llm.decontamination import decontamination_stage
from moleweave.llm.mixing import mixing_stage
from moleweave.llm.near_duplicates import near_dedup_stage
from moleweave.llm.packing import packing_stage
from moleweave.llm.quality import quality_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mix", mixing_stage),
    ("token_packing", packing_stage),
]

#: The packed ids are the work of a tokenizer, which SQL cannot express; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; their tables are in the folder that the cluster shares."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
