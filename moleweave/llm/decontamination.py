"""Benchmark decontamination: exact containment of item windows in documents, by a prefix-filtered set join.

A window is a set of word shingles that a document must contain whole, so one shingle is a sufficient prefix. The
windows' shingles are ordered by their frequency in the corpus, and only the rarest of each window is joined. Its place
in the window bounds where the window can start, the document's length bounds where it can end, and an exact comparison
of the words decides. Only DataFrame functions are used. The corpus is gone through once for each of a few blocks of
windows, whose keys are broadcast to it; for more windows its shingles are shuffled by key instead. Keys and numbers of
windows are all that is broadcast: the words to compare come to the candidates alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moleweave.llm.common import ascii_lower, bind, cut, lookup, table

WINDOW, SHINGLE = 10, 5
#: Windows in one broadcast block, and the most blocks for which the corpus is gone through again.
BLOCK, BLOCKS = 200_000, 4
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """Lower-cased words of letters, digits and all characters beyond ASCII; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def shingle(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.slice(words, at, n))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, words): every window's words once per item."""
    words = items.select(F.col("item_id"), item_words(F.col("text")).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - (window - 1)))
    return words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("all", i, window))).alias("words")).distinct()


def window_shingles(size: int, n: int) -> Column:
    """The shingles of column words, which has ``size`` words, with their 0-based offsets."""
    return F.array(*[F.struct(F.lit(i).alias("offset"), shingle(F.col("words"), F.lit(i + 1), n).alias("key")) for i in range(size - n + 1)])


def corpus_shingles(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """doc_id, h, n (the document's words) and one row for each shingle: (at, key), at 1-based."""
    def every(n: int) -> Column:
        return F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(1), F.size("words") - (n - 1)), lambda i: shingle(F.col("words"), i, n))).otherwise(F.array().cast("array<bigint>"))

    words = docs.select("doc_id", "h", item_words(F.col("text")).alias("words")).select("doc_id", "h", "words", F.size("words").alias("n"))
    parts = [words.select("doc_id", "h", "n", F.posexplode(every(n)).alias("at", "key")) for n in lengths]
    return reduce(DataFrame.unionAll, parts).withColumn("at", F.col("at") + 1)


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, h, item_id, start, size): where item windows occur in documents; ``docs`` has doc_id, h and text.

    The corpus is gone through once for each block: places of any of the block's shingles are written down, which gives
    the shingles' frequencies, and the places of the rarest ones are candidates. The words of documents that have
    candidates are then compared.
    """
    windows = cut(item_windows(items, window).withColumn("size", F.size("words")))
    shapes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # 1 to `window`, so at most that many
    if not shapes:
        return docs.select("doc_id", "h", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("start"), F.lit(0).alias("size")).where("false")
    shingled = [
        windows.where(F.col("size") == k).withColumn("shingles", window_shingles(k, min(SHINGLE, k))).withColumn("n", F.lit(min(SHINGLE, k))) for k in shapes
    ]
    windows = cut(reduce(DataFrame.unionAll, shingled).withColumn("wid", F.xxhash64("words")))
    lengths = sorted({min(SHINGLE, k) for k in shapes})
    blocks = -(-windows.count() // BLOCK)
    many = blocks > BLOCKS
    blocks = 1 if many else blocks

    def meet(big: DataFrame, small: DataFrame) -> DataFrame:
        """Places of shingles with the rows of their keys: a block's are broadcast, more of them are dealt out by salts, as one key may be everywhere."""
        return lookup(big, small, ["key"], "inner", limit=0) if many else big.join(F.broadcast(small), "key")

    found = []
    for block in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block)
        keys = part.select(F.explode("shingles.key").alias("key")).distinct()
        seen = cut(meet(corpus_shingles(docs, lengths), keys.withColumn("asked", F.lit(True))).drop("asked"))
        often = seen.groupBy("key").agg(F.count("*").alias("often"))
        ranked = part.select("wid", "size", F.explode("shingles").alias("s")).distinct().select("wid", "size", "s.offset", "s.key")
        rarest = F.min(F.struct(F.col("often"), F.col("offset"), F.col("key"))).alias("rarest")
        prefix = ranked.join(cut(often), "key", "left").withColumn("often", F.coalesce("often", F.lit(0))).groupBy("wid", "size").agg(rarest).where("rarest.often > 0")
        prefix = cut(prefix.select("rarest.key", "rarest.offset", "size", "wid"))
        start = F.col("at") - F.col("offset")
        near = meet(seen, prefix).where((start >= 1) & (start + F.col("size") - 1 <= F.col("n")))
        near = cut(near.groupBy("doc_id", "h").agg(F.collect_set(F.struct(start.alias("start"), "size", "wid")).alias("near")))
        # Only the candidates' keys, which are narrow, may be broadcast; the places come by a shuffle of candidates alone.
        asked = lookup(docs.select("doc_id", "h", "text"), near.select("doc_id", "h", F.lit(1).alias("one")), ["doc_id", "h"], "inner", salts=1)
        near = near.select(F.col("doc_id").alias("__d"), F.col("h").alias("__g"), "near")
        asked = asked.join(near.hint("merge"), asked["doc_id"].eqNullSafe(near["__d"]) & (asked["h"] == near["__g"]))
        at = lambda words, x: F.slice(words, x["start"], x["size"])
        right = lambda words: F.transform(F.filter("near", lambda x: F.xxhash64(at(words, x)) == x["wid"]), lambda x: F.struct(x["wid"].alias("wid"), x["start"].alias("start"), x["size"].alias("size"), at(words, x).alias("words")))
        hits = asked.select("doc_id", "h", F.explode(bind(item_words(F.col("text")), right)).alias("x")).select("doc_id", "h", "x.*")
        items_of = cut(part.select("wid", "size", "item_id", F.col("words").alias("asked")).distinct())
        found.append(lookup(hits, items_of, ["wid", "size"], "inner").where(F.col("words") == F.col("asked")).select("doc_id", "h", "item_id", "start", "size"))
    return reduce(DataFrame.unionAll, found)


def covered(spans: Column) -> Column:
    """Positions that the spans (start, size) cover."""
    step = lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(x["start"], a["end"]))).alias("n"), F.greatest(a["end"], x["start"] + x["size"]).alias("end")
    )
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"].cast("long"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text), (item_id, text) -> doc_id, h, n_words, n_hit, n_items, items_sha256, contaminated; one row per row.

    Null and empty texts have no words, are never hit, and as items have no window. Repeated rows each get their row;
    repeated items count once by id. An empty side gives documents without hits. Other columns are ignored.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    hits = matches(docs, items.select("item_id", "text"), window)
    spans = hits.groupBy("doc_id", "h", "item_id").agg(F.collect_set(F.struct("start", "size")).alias("spans"))
    spans = spans.groupBy("doc_id", "h").agg(covered(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("n_hit"), F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("ids"))
    spans = spans.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "n_hit", "ids")
    base = docs.select("doc_id", "h", F.coalesce(F.regexp_count(ascii_lower(F.col("text")), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return base.join(spans, base["doc_id"].eqNullSafe(spans["d"]) & base["h"].eqNullSafe(spans["g"]), "left").select(
        "doc_id", "h", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no item window occurs, in the columns of ``docs``."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    hit = matches(keyed, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__d"), F.col("h").alias("__h")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["__d"]) & (F.xxhash64(docs["text"]) == hit["__h"]), "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS h, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i+9], ' ') AS k FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS i FROM b WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM w),
g AS (SELECT doc_id, h, n, i, array_to_string(ws[i:i+n-1], ' ') AS k FROM (SELECT doc_id, h, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT DISTINCT doc_id, h, ws FROM d), ns)),
m AS (SELECT doc_id, h, i, g.n, item_id FROM g JOIN w ON g.n = w.n AND g.k = w.k),
p AS (SELECT doc_id, h, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, h, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1, 2),
q AS (SELECT doc_id, h, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, h, item_id::VARCHAR AS item FROM m) GROUP BY 1, 2)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id AND d.h = p.h LEFT JOIN q ON d.doc_id = q.doc_id AND d.h = q.h
"""

QUERIES = {"op6_benchmark_decontamination": op6_benchmark_decontamination}
ORACLES = {"op6_benchmark_decontamination": ORACLE}
