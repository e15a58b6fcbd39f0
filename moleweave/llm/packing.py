"""Token ids packed into rows of one length by best-fit-decreasing, written as binary files.

Each task encodes its partition and packs it by blocks of a bounded number of tokens, so nothing is shuffled and memory
does not grow with the partition. Documents longer than a row are split into pieces without loss. In a block, pieces go
from the longest to the shortest into the row with the least room that is enough, found in a segment tree over room.

Files lie in a folder that executors share: a matrix of ids, cumulative lengths of the segments, a bit for each token at
which positions begin anew, and the segments' documents. A task names them by partition and attempt, and only those in
the manifest of its successful attempt are used later, so a lost or repeated task leaves nothing that is read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from moleweave.llm.common import cut, fresh_dir, table

ROW_TOKENS = 2048
#: Tokens packed at once.
BLOCK_TOKENS = 1 << 20
#: Rows in one Arrow batch of results.
OUT_ROWS = 256
#: Rows of one file, about.
ROLL_ROWS = 1 << 15
#: White space of this length is cut out for the encoder, whose pattern fails on much longer runs.
LONG_SPACE = 10_000
MANIFEST = "path string, first_row long, n_rows long, width int, id_bytes int, n_segments long"
FILES = ("ids", "cu", "resets", "segments")
SEGMENTS = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32())])


@lru_cache(maxsize=4)
def load_ranks(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoder(path: str, pattern: str):
    """text -> ids, whatever runs of one character are in it.

    The pattern gives a run of white space, but for its last character if something follows, as one piece. So the text
    before it, this piece, and the rest from that last character on can be encoded on their own.
    """
    plain, whole = load_ranks(path, pattern).encode_ordinary, load_ranks(path, r"[\s\S]+").encode_ordinary
    runs = regex.compile(rf"\p{{White_Space}}{{{LONG_SPACE},}}")

    def encode(text: str) -> list[int]:
        if len(text) < LONG_SPACE:
            return plain(text)
        ids: list[int] = []
        at = 0
        for run in runs.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += plain(text[at:run.start()]) + whole(text[run.start():end])
            at = end
        return ids + plain(text[at:])

    return encode


class RoomTree:
    """Which amounts of room some open row has: a segment tree whose leaves are the amounts 0 to ``most``."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.leaves
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The row with the least room of at least ``size``, and that room; the row is taken out."""
        i = size + self.leaves
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i + (not self.any[2 * i])
        room = i - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.any[i] = 0
            i >>= 1
            while i and not (self.any[2 * i] or self.any[2 * i + 1]):
                self.any[i] = 0
                i >>= 1
        return row, room


def best_fit_decreasing(sizes: list[int], most: int) -> list[list[int]]:
    """Rows of indices into ``sizes``, each of at most ``most`` in all. Sizes are from 1 to ``most``."""
    tree, rows = RoomTree(most), []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = tree.take(sizes[k])
        if found is None:
            found = len(rows), most
            rows.append([])
        row, room = found
        rows[row].append(k)
        if room > sizes[k]:
            tree.add(room - sizes[k], row)
    return rows


def matrices(pieces: list[tuple], rows: list[list[int]], width: int, pad: int, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]:
    """The rows' ids, cumulative lengths, bits of the segments' first tokens, and the segments."""
    ids, first = np.full((len(rows), width), pad, kind), np.zeros((len(rows), width), bool)
    ends: list[int] = []
    for r, row in enumerate(rows):
        end = 0
        ends.append(0)
        for k in row:
            piece = pieces[k][2]
            ids[r, end:end + len(piece)] = piece
            first[r, end] = True
            end += len(piece)
            ends.append(end)
    segments = [pieces[k][:2] for row in rows for k in row]
    columns = [pa.array([x[i] for x in segments], f.type) for i, f in enumerate(SEGMENTS)]
    return ids, np.array(ends, "<i4"), np.packbits(first, axis=1), pa.RecordBatch.from_arrays(columns, schema=SEGMENTS)


class Writer:
    """The files of a task's rows; they roll over at a number of rows."""

    def __init__(self, root: str, width: int, kind: str, first: int, roll: int) -> None:
        self.store, self.folder = fs.FileSystem.from_uri(root)
        self.store.create_dir(self.folder, recursive=True)
        self.width, self.kind, self.roll = width, kind, roll
        task = TaskContext.get()
        self.stem, self.made, self.row = f"{task.partitionId():06d}-{task.taskAttemptId()}", 0, first
        self.files: dict | None = None
        self.manifest: list[tuple] = []

    def write(self, ids: np.ndarray, ends: np.ndarray, resets: np.ndarray, segments: pa.RecordBatch) -> None:
        if self.files is None:
            self.name, self.first, self.segments = f"{self.stem}-{self.made:05d}", self.row, 0
            self.files = {x: self.store.open_output_stream(f"{self.folder}/{self.name}.{x}", compression=None) for x in FILES}
            self.table = pa.ipc.new_stream(self.files["segments"], SEGMENTS)
        for x, block in (("ids", ids), ("cu", ends), ("resets", resets)):
            self.files[x].write(np.ascontiguousarray(block).tobytes())
        self.table.write_batch(segments)
        self.row, self.segments = self.row + len(ids), self.segments + segments.num_rows
        if self.row - self.first >= self.roll:
            self.close()

    def close(self) -> None:
        if self.files is not None:
            self.table.close()
            for f in self.files.values():
                f.close()
            self.manifest.append((self.name, self.first, self.row - self.first, self.width, np.dtype(self.kind).itemsize, self.segments))
            self.files, self.made = None, self.made + 1


def write_packed(docs: DataFrame, root: str, ranks: str, pattern: str, width: int = ROW_TOKENS, pad: int = 0, block: int = BLOCK_TOKENS, roll: int = ROLL_ROWS) -> DataFrame:
    """(doc_id, text) -> packed files below ``root``; their manifest, a row for each set of files ``path`` + .ids and so on.

    .ids has n_rows x width little-endian ids of id_bytes bytes, filled up with ``pad``; .cu has for each row where its
    segments begin and the last one ends, as 32-bit numbers, the first of a row being 0; .resets has a bit for each
    token, a row filled up to whole bytes, set where a segment and so its positions begin; .segments has document and
    number of piece for each segment, as an Arrow stream. Which documents share a row depends on the partitions of
    ``docs``; no document is in two partitions' rows, and each comes back whole from any packing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, pattern)
        kind = "<u2" if max(load_ranks(ranks, pattern).n_vocab - 1, pad) < 1 << 16 else "<u4"
        out = Writer(root, width, kind, TaskContext.get().partitionId() << 33, roll)
        pieces: list[tuple] = []
        held = 0

        def flush() -> None:
            nonlocal pieces, held
            if pieces:
                rows = best_fit_decreasing([len(ids) for *_, ids in pieces], width)
                for i in range(0, len(rows), OUT_ROWS):
                    out.write(*matrices(pieces, rows[i:i + OUT_ROWS], width, pad, kind))
            pieces, held = [], 0

        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = np.array(encode(text.as_py() or ""), kind)
                doc_id = doc.as_py()
                for n, i in enumerate(range(0, len(ids), width)):
                    pieces.append((doc_id, n, ids[i:i + width]))
                    held += len(pieces[-1][2])
                    if held >= block:
                        flush()
        flush()
        out.close()
        columns = list(zip(*out.manifest, strict=True)) or [[]] * 6
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in MANIFEST.split(", ")])

    return cut(docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, MANIFEST))


SCHEMA = "row_id long, input_ids array<int>, cu_seqlens array<int>, position_ids array<int>, doc_ids array<long>, pieces array<int>, n_tokens int"


def row_batch(ids: np.ndarray, resets: np.ndarray, ends: np.ndarray, segments: pa.Table, first: int) -> pa.RecordBatch:
    n, width = ids.shape
    counts = resets.sum(1)
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    cuts = np.concatenate([[0], np.cumsum(counts + 1)]).astype(np.int32)
    used = ends[cuts[1:] - 1]
    at = np.arange(width, dtype=np.int32)
    position = np.where(at < used[:, None], at - np.maximum.accumulate(np.where(resets, at, 0), axis=1), 0).astype(np.int32)
    lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets), values)
    matrix = lambda x: lists(np.arange(0, x.size + 1, width, dtype=np.int32), pa.array(x.ravel()))
    plain = lambda name: segments[name].combine_chunks() if segments.num_rows else pa.array([], SEGMENTS.field(name).type)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(first, first + n, dtype=np.int64)), matrix(ids.astype(np.int32)), lists(cuts, pa.array(ends)), matrix(position), lists(starts, plain("doc_id")), lists(starts, plain("piece")), pa.array(used)],
        [x.split()[0] for x in SCHEMA.split(", ")],
    )


def read_packed(manifest: DataFrame, root: str) -> DataFrame:
    """The rows of packed files, a bounded number at a time: ids, cumulative lengths, positions and segments of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(root)
        for batch in batches:
            for f in batch.to_pylist():
                ids, cu, bits, table_ = (store.open_input_stream(f"{folder}/{f['path']}.{x}", compression=None) for x in FILES)
                with ids, cu, bits, table_, pa.ipc.open_stream(table_) as reader:
                    width, row, left = f["width"], 0, SEGMENTS.empty_table()
                    while row < f["n_rows"]:
                        n = min(OUT_ROWS, f["n_rows"] - row)
                        matrix = np.frombuffer(ids.read(n * width * f["id_bytes"]), f"<u{f['id_bytes']}").reshape(n, width)
                        resets = np.unpackbits(np.frombuffer(bits.read(n * -(-width // 8)), np.uint8).reshape(n, -1), axis=1, count=width).astype(bool)
                        some = int(resets.sum())
                        while left.num_rows < some:
                            left = pa.concat_tables([left, pa.Table.from_batches([reader.read_next_batch()])])
                        yield row_batch(matrix, resets, np.frombuffer(cu.read(4 * (some + n)), "<i4"), left.slice(0, some), f["first_row"] + row)
                        left, row = left.slice(some), row + n

    return manifest.mapInArrow(run, SCHEMA)


def pack(docs: DataFrame, ranks: str, pattern: str, width: int = ROW_TOKENS, pad: int = 0, block: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, text) -> rows of ``width`` ids with the segments in them, written to binary files and read from those.

    A row has its segments' ids, filled up with ``pad``; cu_seqlens, where each segment begins and the last one ends;
    position_ids, which begin at 0 in each segment; and each segment's document and number within that document, so
    documents can be put together again. Texts without tokens (null or empty) are in no row; repeated rows and ids are
    packed as often as they come; a null doc_id is kept. Other columns are ignored; an empty table gives no row.
    """
    root = fresh_dir(docs.sparkSession, "packed")
    return read_packed(write_packed(docs, root, ranks, pattern, width, pad, block), root)


def own_pack(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, packed."""
    return own_pack(docs)


def op10_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return own_pack(table(spark, sf_dir, "documents"))


QUERIES = {"op10_token_packing": op10_token_packing}
ORACLES: dict[str, str] = {}
