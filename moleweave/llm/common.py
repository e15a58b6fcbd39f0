"""Helpers that the training-data operators share: shared storage, skew-safe joins and word rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tables of at most so many bytes are broadcast by :func:`lookup`.
BROADCAST_BYTES = 8 << 20
#: ASCII white space: space and the control characters from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The URI of this session's folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that is unset, and only in a local session (one machine, as in tests), a temporary folder is made.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    uri = sc.getCheckpointDir()
    return f"file://{uri.removeprefix('file:')}" if uri.startswith(("/", "file:/")) and not uri.startswith("file://") else uri


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage at a reliable checkpoint, which survives lost executors and ends with its last user."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def keep(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """The same as a compressed table in the shared folder, for wide or many rows that are read more than once."""
    path = fresh_dir(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def row_bytes(kind: T.DataType, value: Column) -> Column:
    """About how many bytes a value takes, from the lengths of what is of no fixed width."""
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return none(F.octet_length(value)) + 16
    if isinstance(kind, T.StructType):
        return sum((row_bytes(f.dataType, value[f.name]) for f in kind), F.lit(8))
    if isinstance(kind, T.MapType):
        entries = T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))
        return row_bytes(entries, F.map_entries(value))
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        fixed = inner.fields if isinstance(inner, T.StructType) else [T.StructField("", inner)]
        if not any(isinstance(f.dataType, (T.StringType, T.BinaryType, T.StructType, T.MapType, T.ArrayType)) for f in fixed):
            return none(F.size(value)) * (8 * len(fixed) + (16 if isinstance(inner, T.StructType) else 0)) + 24
        return none(F.aggregate(value, F.lit(24).cast("long"), lambda n, x: n + row_bytes(inner, x)))
    return F.lit(8).cast("long")


def total_bytes(df: DataFrame) -> int:
    """About how many bytes the rows take in memory; one pass over ``df``."""
    return df.agg(F.sum(sum((row_bytes(f.dataType, F.col(f.name)) for f in df.schema), F.lit(16)))).first()[0] or 0


def lookup(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_BYTES, salts: int = 16) -> DataFrame:
    """Join ``big`` to the table ``small``, unique in ``on``, whatever the skew of ``big``'s keys.

    The bytes of ``small`` are summed up (it should be cut or cheap). Up to ``limit`` of them it is broadcast; beyond, or at 0,
    each of its rows is repeated under ``salts`` salts and ``big`` is dealt out by key and salt, so that one key's rows
    go to that many tasks. Keys match as null-safe equals; ``on`` keeps ``big``'s columns.
    """
    small = small.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)], *[c for c in small.columns if c not in on])
    match = [same(big[c], small[f"__k{i}"]) for i, c in enumerate(on)]
    keys = [f"__k{i}" for i in range(len(on))]
    if limit and total_bytes(small) <= limit:
        return big.join(F.broadcast(small), match, how).drop(*keys)
    small = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rest = [c for c in big.columns if c not in on] or on
    big = big.withColumn("__slot", F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int"))
    match = [same(big[c], small[f"__k{i}"]) for i, c in enumerate(on)]
    return big.join(small, [*match, big["__slot"] == small["__salt"]], how).drop(*keys, "__salt", "__slot")


def word_array(text: Column) -> Column:
    """The words between ASCII white space; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone, as the built-in lower() changes other letters too."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def bind(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once, however often ``then`` mentions it, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), then), 1)


def set_aside(docs: DataFrame, names: tuple[str, ...], run) -> DataFrame:
    """``run(docs)`` with the columns of ``docs`` that bear one of the names of inner columns renamed, and then named as before."""
    own = {c: f"__own_{c}" for c in docs.columns if c in names}
    return run(docs.withColumnsRenamed(own)).withColumnsRenamed({v: k for k, v in own.items()}) if own else run(docs)


def once(docs: DataFrame, value: Column, then) -> DataFrame:
    """Add the fields of the struct ``then(value)``; each row's is computed once, whatever later steps ask of them.

    A plain projection would be copied into every filter and expression that uses it, an explode is not.
    """
    return docs.withColumn("__once", F.explode(F.transform(F.array(value), then))).select(*docs.columns, "__once.*")
