"""A Spark data source for files of one molecule a line: large files are read by many tasks, each from its own range of bytes.

    spark.dataSource.register(SmilesLines)
    spark.read.format("smiles_lines").option("path", "file:///data").load()      # smiles, name, file, offset

A range takes the lines that begin in it, so each line is read once, wherever the cuts fall.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringContains, StringStartsWith

SCHEMA = "smiles string, name string, file string, offset long"
#: Bytes of a range, and bytes read at once.
SPLIT_BYTES, READ_BYTES = 64 << 20, 1 << 20


@dataclass
class Range(InputPartition):
    file: str
    begin: int
    end: int


def lines(stream, begin: int, end: int, size: int = READ_BYTES) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin at ``begin`` or later and before ``end``."""
    at = max(0, begin - 1)
    stream.seek(at)
    rest, skip = b"", begin > 0
    while data := stream.read(size):
        parts = (rest + data).split(b"\n")
        rest = parts.pop()
        for part in parts:
            # The first part belongs to a line that began before; it is empty if the byte before the range ends a line.
            if not skip:
                if at >= end:
                    return
                yield at, part
            skip = False
            at += len(part) + 1
        if at >= end and not skip:
            return
    if rest and not skip and at < end:
        yield at, rest


class Reader(DataSourceReader):
    """Options: path, a file or folder; splitBytes; contains, texts that a line's molecule has to contain, by commas."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.split = options["path"], int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.tests: list[tuple[str, str]] = [("contains", x) for x in options.get("contains", "").split(",") if x]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Conditions on the text of the molecule are asked while lines are read."""
        kinds = {EqualTo: "equals", StringContains: "contains", StringStartsWith: "starts"}
        for f in filters:
            if type(f) in kinds and f.attribute == ("smiles",) and isinstance(f.value, str):
                self.tests.append((kinds[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        store, path = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((i for i in found if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))), key=lambda i: i.path)
        return [Range(i.path, at, min(at + self.split, i.size)) for i in files for at in range(0, i.size, self.split)]

    def keeps(self, smiles: str) -> bool:
        ask = {"equals": smiles.__eq__, "contains": smiles.__contains__, "starts": smiles.startswith}
        return all(ask[kind](value) for kind, value in self.tests)

    def read(self, partition: Range) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.file) as stream:
            for at, line in lines(stream, partition.begin, partition.end):
                smiles, _, name = line.decode("utf-8", "replace").rstrip("\r").replace("\t", " ").partition(" ")
                if smiles and self.keeps(smiles):
                    yield smiles, name.strip() or None, partition.file, at


class SmilesLines(DataSource):
    """Lines of a molecule's text and, after white space, a name. Empty lines, and those that begin with white space, are left out."""

    @classmethod
    def name(cls) -> str:
        return "smiles_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def register_source(spark: SparkSession) -> None:
    """Make the format known, and let Spark hand conditions over to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SmilesLines)
