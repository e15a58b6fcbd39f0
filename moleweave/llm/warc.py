"""WARC archives: writing, normalising to one gzip member for each record, and reading by a sidecar offset index.

Archives are files in a folder that executors share, reached from tasks through Arrow's file systems. A task names its
files by partition and attempt, and only files in the manifest of its successful attempt are used later, so a lost or
repeated task leaves nothing that is read. Files roll over at a size, so no task holds more than one record and buffer.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moleweave.llm.common import cut, fresh_dir, lookup, table

#: Payloads from this size on are stored once; others revisit them.
SHARED_BYTES = 100
#: An archive ends after about this many bytes of records.
ROLL_BYTES = 32 << 20
READ_BYTES = 1 << 20
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, index string, records long, bytes long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, digest: str, at: str | None = None) -> str:
    """The id of a page's record; of pages that come with this payload several times, also by its place in the archives."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}' + (f':{at}' if at else ''))}>"


def record(page_id, url, payload: bytes, digest: str, refers_to, at: str | None = None, several: bool = False) -> bytes:
    """One WARC record; with ``refers_to``, a revisit record without the payload, which names no id if it could be ``several``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest, at)}", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {''.join(url.split())}"] if url else []), f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"] if refers_to is not None else []),
        *([f"WARC-Refers-To: {record_id(refers_to, digest)}"] if refers_to is not None and not several else []),
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", "",
    ]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    """The fields by name in lower case; lines that begin with white space go on with the field before them."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record; of other content than an HTTP message the whole block is the payload."""
    head, _, block = raw.partition(b"\r\n\r\n")
    warc = headers(head)
    block = block[: int(warc["content-length"])]
    if not warc.get("content-type", "").lower().startswith("application/http") and not block.startswith(b"HTTP/"):
        return warc, {}, block
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, headers(http), payload


def inflated(stream, size: int = READ_BYTES) -> Iterator[bytes]:
    """The content of a gzip stream of one member or several, in pieces of ``size`` bytes at most, however well it is packed."""
    inflate, open_ = zlib.decompressobj(31), False
    while data := stream.read(size):
        while data or inflate.unconsumed_tail:
            open_ = True
            yield inflate.decompress(inflate.unconsumed_tail or data, size)
            if inflate.eof:
                data, inflate, open_ = inflate.unused_data, zlib.decompressobj(31), False
            else:
                data = b""
    if open_:
        raise ValueError("the archive ends within a member")


def records(stream) -> Iterator[bytes]:
    """The raw records of an archive, with no more than one and a read buffer in memory."""
    buffer, need = bytearray(), 0
    for data in inflated(stream):
        buffer += data
        while True:
            if not need:
                at = buffer.find(b"\r\n\r\n")
                if at < 0:
                    break
                need = at + 4 + int(headers(bytes(buffer[:at]))["content-length"]) + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = 0
    if buffer:
        raise ValueError("the archive ends within a record")


def manifest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "index", "records", "bytes"])


def write_warc(pages: DataFrame, root: str, roll: int = ROLL_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to, repeated, several) -> archives below ``root``, each one gzip stream; their manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, folder = place(root)
        store.create_dir(folder, recursive=True)
        out = None
        made, rows = 0, []

        def close() -> None:
            out.write(deflate.flush())
            out.close()
            rows.append((name, None, count, size))

        for row in (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist()):
            if out is None:
                name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{made:05d}.warc.gz"
                out, deflate, count, size = store.open_output_stream(f"{folder}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
            at = f"{task.partitionId()}:{len(rows)}:{count}" if row["repeated"] else None
            raw = record(row["page_id"], row["url"], (row["payload"] or "").encode(), row["digest"], row["refers_to"], at, row["several"])
            out.write(deflate.compress(raw))
            count, size = count + 1, size + len(raw)
            if size >= roll:
                close()
                out, made = None, made + 1
        if out is not None:
            close()
        yield manifest_batch(rows)

    return cut(pages.select("page_id", "url", "payload", "digest", "refers_to", "repeated", "several").mapInArrow(run, MANIFEST))


def normalise_warc(manifest: DataFrame, source: str, root: str) -> DataFrame:
    """Rewrite archives, inflated once as whole streams, with a gzip member for each record and a sidecar index.

    The index has a JSON line for each record: id, type, offset and length of its member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        (store, folder), (to, target) = place(source), place(root)
        to.create_dir(target, recursive=True)
        for batch in batches:
            rows = []
            for name in batch.column("path").to_pylist():
                new, at, count = f"{name.removesuffix('.warc.gz')}-{attempt}.warc.gz", 0, 0
                with store.open_input_stream(f"{folder}/{name}", compression=None) as stream, to.open_output_stream(f"{target}/{new}", compression=None) as out, to.open_output_stream(f"{target}/{new}.idx", compression=None) as index:
                    for raw in records(stream):
                        deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = deflate.compress(raw) + deflate.flush()
                        warc = headers(raw[: raw.find(b"\r\n\r\n")])
                        index.write(json.dumps({"id": warc.get("warc-record-id"), "type": warc.get("warc-type"), "offset": at, "length": len(member)}).encode() + b"\n")
                        out.write(member)
                        at, count = at + len(member), count + 1
                rows.append((new, f"{new}.idx", count, at))
            yield manifest_batch(rows)

    return cut(manifest.mapInArrow(run, MANIFEST))


def read_warc(manifest: DataFrame, root: str) -> DataFrame:
    """The records of normalised archives, each read at its offset; digests of stored payloads are computed anew."""
    fields = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "archive": pa.string(), "offset": pa.int64(), "length": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = place(root)
        for batch in batches:
            for name, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist(), strict=True):
                rows = []
                with store.open_input_file(f"{folder}/{name}") as file, store.open_input_stream(f"{folder}/{index}", compression=None) as entries:
                    for entry in map(json.loads, entries.read().splitlines()):
                        file.seek(entry["offset"])
                        warc, http, payload = parse(zlib.decompress(file.read(entry["length"]), 31))
                        if warc.get("warc-record-id") != entry["id"]:
                            raise ValueError(f"{name}: the index does not fit at {entry['offset']}")
                        number = lambda key: int(warc[key]) if key in warc else None
                        revisit = warc.get("warc-type") == "revisit"
                        digest = warc.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                        size = int(http.get("content-length", 0)) if revisit else len(payload)
                        rows.append((number("x-page-id"), warc.get("warc-target-uri"), size, digest, warc.get("warc-type"), number("x-refers-to-page"), name, entry["offset"], entry["length"]))
                columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True)], list(fields))

    return manifest.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long")


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> page_id, url, payload, digest, refers_to, repeated, several.

    refers_to is the least page of equal, not small, payloads; repeated, whether other rows have the page_id and payload
    too; several, whether more than one row has those that are referred to.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = pages.where(F.octet_length("payload") >= SHARED_BYTES)
    groups = cut(large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"))
    again = cut(pages.groupBy("page_id", "digest").agg(F.count("*").alias("n")).where("n > 1").select("page_id", "digest", F.lit(True).alias("repeated")))
    found = lookup(pages, groups, ["digest"]).withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("refers_to")))
    found = lookup(found, again, ["page_id", "digest"])
    found = lookup(found, again.select(F.col("page_id").alias("refers_to"), "digest", F.lit(True).alias("several")), ["refers_to", "digest"])
    return found.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("repeated", "several")})


def resolved(records: DataFrame) -> DataFrame:
    """The records with size and digest of a revisit taken from the stored payload that it refers to; an error if there is none."""
    records = cut(records)
    # A payload that many pages refer to is a hot key on the side of the revisits alone.
    stored = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("payload_bytes").alias("__n"))
    referred = lookup(records.where("record_type = 'revisit'").select("refers_to", "payload_digest").distinct(), cut(stored), ["refers_to", "payload_digest"], "left")
    asked = lookup(records.where("record_type = 'revisit'"), cut(referred), ["refers_to", "payload_digest"])
    missing = F.raise_error(F.concat(F.lit("no payload for the revisit of page "), F.col("refers_to").cast("string"))).cast("long")
    asked = asked.withColumn("payload_bytes", F.when(F.col("__n").isNotNull(), F.col("__n")).otherwise(missing)).drop("__n")
    return records.where("record_type <> 'revisit' or record_type is null").unionByName(asked)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives, normalise these, and read them back: a row for each record.

    A null html is an empty payload. Of equal payloads of at least ``SHARED_BYTES`` bytes, the least page_id's is stored,
    and rows that repeat that page_id are stored too; a null page_id is never the one referred to. Record ids are unique,
    also of repeated rows. An archive that is cut off anywhere is an error. Line breaks and spaces in a url are dropped
    from its header. An empty table gives no record. Other columns are ignored.
    """
    spark = pages.sparkSession
    raw, normal = fresh_dir(spark, "warc"), fresh_dir(spark, "warc-records")
    return resolved(read_warc(normalise_warc(write_warc(with_revisits(pages), raw), raw, normal), normal))


def op4_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS s FROM p),
m AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY s) END AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, s AS payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM m
"""

QUERIES = {"op4_warc_normaliser": op4_warc_normaliser}
ORACLES = {"op4_warc_normaliser": ORACLE}
