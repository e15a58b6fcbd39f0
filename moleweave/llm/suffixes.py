"""Repeated passages by a sparse suffix array.

Suffixes are kept at the positions that hold the least run hash of a window of positions, which depends on content
alone, so every copy of a passage keeps the same ones. Suffixes whose first words no other document has are dropped.
The rest are range-sorted by their words across the cluster and compared with their neighbours of other documents, and
each match is extended to the left and to the right. Exact copies of whole texts are one text throughout.

Lengths: a passage of ``PASSAGE`` words keeps a suffix among its first ``WINDOW`` positions, which therefore matches for
``PREFIX`` words at least; with ``LEFT`` words before it and ``RIGHT`` after it, matches of neighbouring suffixes overlap.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moleweave.llm.common import cut, keep, lookup, shuffles, table, word_array
from moleweave.llm.near_duplicates import mix64

PASSAGE, RUN, WINDOW = 50, 8, 16
PREFIX = PASSAGE - (WINDOW - 1)
LEFT, RIGHT = 16, 52
BASE = 0x9E3779B97F4A7C15
#: Neighbouring partitions whose ends one task compares.
GROUP = 32


def word_hashes(text: Column) -> Column:
    return F.transform(word_array(text), lambda w: F.xxhash64(w))


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, from the front; doubling, so in a few passes over the words."""
    with np.errstate(over="ignore"):
        out, done, part, have = None, 0, words.copy(), 1
        while True:
            if size & have:
                shifted = part[done:]
                out = shifted if out is None else mix64(out[: len(shifted)] * np.uint64(BASE) + shifted, have)
                done += have
            if done == size:
                return out[: max(0, len(words) - size + 1)]
            part = mix64(part[: len(part) - have] * np.uint64(BASE) + part[have:], have + 64)
            have *= 2


def kept_positions(words: np.ndarray) -> np.ndarray:
    """Positions of the least run hash of each window, the rightmost of equals, in one text."""
    runs = rolled(words, RUN) if len(words) >= RUN + WINDOW - 1 else np.empty(0, np.uint64)
    if len(runs) < WINDOW:
        return np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(runs[::-1], WINDOW)
    last = len(runs) - 1 - (np.arange(len(windows)) + windows.argmin(1))
    return np.unique(last)


def suffix_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, h, words -> doc_id, h, at, key: kept suffixes of ``PREFIX`` words or more, keyed by those words."""
    for batch in batches:
        lists = batch.column("words")
        ends = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        at, key, owner = [], [], []
        for i in range(len(lists)):
            words = values[ends[i]:ends[i + 1]]
            if len(words) >= PREFIX:
                first = kept_positions(words)
                first = first[first + PREFIX <= len(words)]
                at.append(first)
                key.append(rolled(words, PREFIX)[first])
                owner.append(np.full(len(first), i))
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
        owners = pa.array(join(owner, np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(owners), batch.column("h").take(owners), pa.array(join(at, np.int32)), pa.array(join(key, np.uint64).view(np.int64))], ["doc_id", "h", "at", "key"]
        )


def suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, h, words, kept (array of at, key) -> a row for each suffix with its words' hashes as ordered bytes.

    Suffixes of one document that agree in all these words are one row with several places.
    """
    for batch in batches:
        rows = []
        for doc, h, words, kept in zip(*(batch.column(c) for c in ("doc_id", "h", "words", "kept")), strict=True):
            low = (words.values.to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(">u4")
            places: dict[tuple[bytes, bytes, int], list[int]] = {}
            for x in kept.as_py():
                at = x["at"]
                places.setdefault((low[at:at + RIGHT].tobytes(), low[max(0, at - LEFT):at][::-1].tobytes(), x["key"]), []).append(at)
            rows += [(doc.as_py(), h.as_py(), at, key, len(left) // 4, len(right) // 4, right, left) for (right, left, key), at in places.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        types = (batch.schema.field("doc_id").type, pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "h", "at", "key", "n_left", "n_right", "right", "left"])


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each pair of rows."""
    differ = np.concatenate([a != b, np.ones((len(a), 1), bool)], 1)
    return differ.argmax(1)


def matrix(values: pd.Series, width: int, fill: int) -> np.ndarray:
    """The rows' hashes; beyond a row's end, numbers that differ from row to row and from any hash."""
    out = np.zeros((len(values), width), np.uint64)
    for i, x in enumerate(values):
        row = np.frombuffer(x, ">u4")
        out[i, :len(row)] = row
        out[i, len(row):] = (1 << 32) + fill + i
    return out


def neighbours(part: pd.DataFrame) -> pd.DataFrame:
    """Matches of each of the sorted rows with its nearest rows of other documents before and after.

    Where both are long enough, the row's passage reaches as far as either does on each side.
    """
    n = len(part)
    h = part["h"].to_numpy()
    change = np.concatenate([[True], h[1:] != h[:-1]])
    start = np.maximum.accumulate(np.where(change, np.arange(n), 0))
    end = np.append(np.flatnonzero(change)[1:], n)[np.cumsum(change) - 1]
    right, left = matrix(part["right"], RIGHT, 0), matrix(part["left"], LEFT, n)
    best, lcp, other = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1)
    lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for to in (start - 1, end):
        ok = np.flatnonzero((to >= 0) & (to < n))
        r, l = common(right[ok], right[to[ok]]), common(left[ok], left[to[ok]])
        lcp[ok] = np.maximum(lcp[ok], r)
        fits = r + l >= PASSAGE
        lo[ok[fits]], hi[ok[fits]] = np.maximum(lo[ok[fits]], l[fits]), np.maximum(hi[ok[fits]], r[fits])
        better = r + l > best[ok]
        best[ok[better]], other[ok[better]] = (r + l)[better], to[ok][better]
    ids = part["doc_id"].to_numpy(dtype=object)
    return part.assign(best=best, lcp=lcp, lo=lo, hi=hi, other=[ids[k] if k >= 0 else None for k in other])


def without_words(found: pd.DataFrame) -> pd.DataFrame:
    """The words' hashes are needed again at the edges alone."""
    inner = ~found["edge"].to_numpy(bool)
    return found.assign(right=found["right"].mask(inner, None), left=found["left"].mask(inner, None))


def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A sorted partition's rows with their matches, in blocks; two documents' rows at either end are marked as edge.

    A block begins with the last two documents' rows of the one before it, so only a partition's ends lack neighbours.
    """
    held: pd.DataFrame | None = None
    first = True

    def run_starts(h: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))

    def out(block: pd.DataFrame, new_from: int, last: bool) -> pd.DataFrame:
        found = neighbours(block)
        starts = np.append(run_starts(block["h"].to_numpy()), len(block))
        edge = np.zeros(len(block), bool)
        if first:
            edge[: starts[min(2, len(starts) - 1)]] = True
        if last:
            edge[starts[max(0, len(starts) - 3)]:] = True
        found["edge"] = edge
        return without_words(found.iloc[new_from:])

    done = 0
    for batch in batches:
        if not len(batch):
            continue
        block = batch if held is None else pd.concat([held, batch], ignore_index=True)
        starts = run_starts(block["h"].to_numpy())
        if len(starts) < 5:
            held = block
            continue
        # Rows up to the last document but one have both neighbours; the two before them are repeated next time.
        cut_at, back = starts[-1], starts[-3]
        yield out(block, done, False).iloc[: cut_at - done]
        first = False
        held, done = block.iloc[back:].reset_index(drop=True), cut_at - back
    if held is not None:
        yield out(held, done, True)


def compare_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part = TaskContext.get().partitionId()
    for found in compare(batches):
        yield found.assign(part=part)


def compare_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same for each of the groups of rows that come one after another, told by ``part``."""
    rows = (rows for batch in batches for _, rows in batch.groupby("part", sort=False))
    for part, group in groupby(rows, lambda rows: rows["part"].iloc[0]):
        for found in compare(x.drop(columns="part").reset_index(drop=True) for x in group):
            yield found.assign(part=part)


def merged(spans: list[tuple[int, int, object]]) -> list[tuple[int, int, object]]:
    out: list[list] = []
    for begin, until, other in sorted(spans, key=lambda s: s[:2]):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], until)
            out[-1][2] = min((x for x in (out[-1][2], other) if x is not None), default=None)
        else:
            out.append([begin, until, other])
    return [tuple(x) for x in out]


def repeated_passages(docs: DataFrame) -> DataFrame:
    """:func:`passages` for ids of any type: those that are no whole numbers are numbered, in a table that is written once."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, T.IntegralType):
        return passages(docs)
    numbers = keep(docs.select("doc_id").where("doc_id is not null").distinct().withColumn("__n", F.monotonically_increasing_id()), "ids")
    coded = lookup(docs.select("doc_id", "text"), numbers, ["doc_id"])
    found = passages(coded.select(F.col("__n").alias("doc_id"), "text"))
    for c in ("doc_id", "other_doc"):
        found = lookup(found, numbers.select(F.col("__n").alias(c), F.col("doc_id").alias("__id")), [c]).drop(c).withColumnRenamed("__id", c)
    return found.select("doc_id", "start_word", "end_word", "n_words", "other_doc")


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, start_word, end_word, n_words, other_doc: passages of ``PASSAGE`` words or more that
    another document with another text has too, merged where they overlap, and whole texts of that size with copies.

    other_doc is one of the documents that share the passage. Null, empty and short texts have none; rows that repeat a
    doc_id with its text are one document, and a doc_id with several texts has the passages of each; null ids are kept.
    Words are compared by 32-bit hashes, so a word that differs within a passage is overlooked once in 4 * 10^9. Other columns are ignored; an empty table gives none.
    Where three documents or more share a suffix, a passage may begin up to ``WINDOW`` - 1 words late, as those nearest
    by what follows need not be nearest by what goes before.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    same = docs.select("doc_id", "h", F.md5("text").alias("m")).groupBy("h", "m").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    same = cut(same.where("least < most").select("h", "m", "least", "most"))
    marked = lookup(docs.withColumn("m", F.md5("text")), same, ["h", "m"])
    copies = marked.where("least is not null").select("doc_id", "h", F.size(word_array(F.col("text"))).alias("n"), F.when(F.col("doc_id").eqNullSafe(F.col("least")), F.col("most")).otherwise(F.col("least")).alias("other_doc"))
    copies = cut(copies.where(F.col("n") >= PASSAGE).distinct())
    whole_ids = cut(copies.select(F.col("doc_id").alias("__d"), F.col("h").alias("__g")).distinct())
    copies = copies.select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n").cast("long").alias("end_word"), F.col("n").cast("long").alias("n_words"), "other_doc")

    single = marked.where("least is null or doc_id = least").select("doc_id", "h", "text")
    words = word_hashes(F.col("text")).alias("words")
    kept = single.select("doc_id", "h", words).mapInArrow(suffix_keys, "doc_id long, h long, at int, key long")
    shared = cut(kept.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key"))
    found = lookup(kept, shared.withColumn("one", F.lit(1)), ["key"], "inner", limit=0, salts=4)
    found = cut(found.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.collect_set(F.struct("at", "key")).alias("kept")))
    rows = single.join(found, single["doc_id"].eqNullSafe(found["d"]) & (single["h"] == found["g"])).select("doc_id", "h", words, "kept")
    schema = "doc_id long, h long, at array<int>, key long, n_left int, n_right int, right binary, left binary"
    suffixes = keep(rows.mapInArrow(suffix_rows, schema), "suffixes")

    ordered = suffixes.repartitionByRange(shuffles(spark), "right", "left", "h").sortWithinPartitions("right", "left", "h")
    compared = f"{schema}, best long, lcp long, lo long, hi long, other long, edge boolean, part int"
    matched = keep(ordered.mapInPandas(compare_partition, compared), "matches")
    # Where a partition ends, the nearest rows are in the next: the ends of neighbouring partitions are compared by groups
    # of partitions, then the ends of the groups, until there is one group left. No task gets more than a group's ends.
    every, ends, parts = matched, matched, shuffles(spark)
    while parts > 1:
        parts = -(-parts // GROUP)
        group = F.floor(F.col("part") / GROUP).cast("int")
        ends = ends.where("edge").select(*suffixes.columns, group.alias("part")).repartitionByRange(parts, "part").sortWithinPartitions("part", "right", "left", "h")
        ends = cut(ends.mapInPandas(compare_groups, compared))
        every = every.unionAll(ends)
    spans = every.where(F.col("best") >= PASSAGE).select("doc_id", "h", F.explode("at").alias("at"), "lo", "hi", "other")
    spans = spans.select("doc_id", "h", (F.col("at") - F.col("lo")).alias("begin"), (F.col("at") + F.col("hi")).alias("until"), "other")

    # A suffix may match one document far to the right and another far enough to the left and right. Where the nearest
    # rows match for the prefix but are too short in all, every window of the passage length is looked up.
    unsure = cut(every.groupBy("key", "doc_id", "h", F.get("at", F.lit(0)).alias("at")).agg(F.max("best").alias("best"), F.max("lcp").alias("lcp")).where((F.col("best") < PASSAGE) & (F.col("lcp") >= PREFIX)).select("key").distinct())
    asked = lookup(suffixes, unsure.withColumn("one", F.lit(1)), ["key"], "inner", salts=4)
    windows = asked.select("doc_id", "h", "at", "n_left", "n_right", "left", "right", F.explode(F.sequence(F.lit(0), F.lit(WINDOW - 1))).alias("back")).where((F.col("back") <= F.col("n_left")) & (F.col("n_right") >= PASSAGE - F.col("back")))
    whole = F.concat(F.hex(F.expr("substring(left, 1, 4 * back)")), F.lit("|"), F.hex(F.expr(f"substring(right, 1, 4 * ({PASSAGE} - back))")))
    windows = windows.select("doc_id", "h", "at", "back", F.md5(whole).alias("window"))
    shared = windows.groupBy("window").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("lo <> hi").drop("lo", "hi")
    more = lookup(windows, cut(shared), ["window"], "inner", limit=0, salts=4).select("doc_id", "h", F.explode("at").alias("at"), "back", "least", "most")
    begin = (F.col("at") - F.col("back")).cast("long")
    more = more.select("doc_id", "h", begin.alias("begin"), (begin + PASSAGE).alias("until"), F.when(F.col("doc_id") == F.col("least"), F.col("most")).otherwise(F.col("least")).alias("other"))

    @F.pandas_udf("array<struct<begin:long,until:long,other:long>>")
    def join(spans: pd.Series) -> pd.Series:
        plain = lambda x: None if x is None or x != x else int(x)
        return spans.map(lambda rows: [{"begin": b, "until": u, "other": o} for b, u, o in merged([(r["begin"], r["until"], plain(r["other"])) for r in rows])])

    spans = spans.unionAll(more).groupBy("doc_id", "h").agg(F.collect_set(F.struct("begin", "until", "other")).alias("spans"))
    spans = spans.select("doc_id", "h", F.explode(join("spans")).alias("s")).select("doc_id", "h", F.col("s.begin").alias("start_word"), F.col("s.until").alias("end_word"), (F.col("s.until") - F.col("s.begin")).alias("n_words"), F.col("s.other").alias("other_doc"))
    # Copies are listed whole, so the passages of the text that stands for them are not listed again.
    return copies.unionAll(spans.join(whole_ids, spans["doc_id"].eqNullSafe(whole_ids["__d"]) & (spans["h"] == whole_ids["__g"]), "left_anti").drop("h"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLES: dict[str, str] = {}
