"""Molecule operators on streams. They are projections without state, so they run on streams as on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from moleweave.operators.matching import with_matches
from moleweave.operators.molecules import molecules


def screened(stream: DataFrame, smarts: str) -> DataFrame:
    """The molecules of a stream of texts that have a match of the pattern, with their matches."""
    return with_matches(molecules(stream), smarts).where("parse_ok and size(matches) > 0")


def write_screened(stream: DataFrame, smarts: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append them to a table of Parquet files; the checkpoint makes each input count once."""
    return screened(stream, smarts).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
