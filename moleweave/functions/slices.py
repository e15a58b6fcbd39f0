"""Rows of Arrow batches a few at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows that are Python objects at once: those of a whole batch of molecules of 100 atoms take more than a gigabyte.
ROWS = 128


def rows_of(*arrays: pa.Array) -> Iterator[tuple]:
    """The rows of several columns as tuples of Python values."""
    for at in range(0, len(arrays[0]), ROWS):
        yield from zip(*(x.slice(at, ROWS).to_pylist() for x in arrays), strict=True)
