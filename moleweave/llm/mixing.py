"""Mixing sources to target weights by systematic sampling.

A document's expected number of copies is its source's target over the source's size. The expected copies are summed up
within the source as fixed-point integers, one random offset is added, and the document is taken once for every whole
number that its stretch of the sum crosses. The sum runs over hash buckets of bounded size, and within a bucket by size,
so that a source with any share of the rows is spread over many tasks, and words taken stay close to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moleweave.llm.common import cut, lookup, set_aside, table, word_count

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is used at most this many times.
MOST = 3
#: Rows of a bucket, about.
BUCKET_ROWS = 20_000
RESULTS = ("size", "source_size", "target", "copies", "taken")
INNER = ("n_docs", "n_buckets", "step", "start", "bucket", "base", "end")
#: One expected copy as an integer.
ONE = 1 << 32


def hex_hash(text: Column) -> Column:
    """A 32-bit number that other engines compute too."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, n_docs, source_size) -> the same and target, one row per source.

    Sources in order of code points, null last, share the whole size by weight; a target stops at ``most`` times the
    source's size, and the excess is shared again by weight among the others. As the level rises, sources reach their
    stops in the order of stop over weight, so the final level is found in one pass over the sources, whose number is
    that of the mix's own list and not that of the documents.
    """
    by_code = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, after = by_stop.rowsBetween(Window.unboundedPreceding, -1), by_stop.rowsBetween(0, Window.unboundedFollowing)
    return (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_code) - 1) % len(weights) + 1).cast("int")))
        .withColumn("stop", F.col("source_size") * most)
        .withColumn("level", (F.sum("source_size").over(Window.partitionBy(F.lit(1))) - F.coalesce(F.sum("stop").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("place", F.row_number().over(by_stop))
        .withColumn("free", F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.struct("place", "level")))
        .withColumn("final", F.min("free").over(Window.partitionBy(F.lit(1)))["level"])
        .withColumn("target", F.least(F.col("stop").cast("double"), F.coalesce(F.col("final") * F.col("weight"), F.col("stop").cast("double"))))
        .select("source", "n_docs", "source_size", "target")
    )


def mix(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken, one row per input row; other columns are carried.

    ``docs`` needs doc_id, text and source. Size is the number of words; null and empty texts have size 0 and are taken
    or not like others, at no words. Null is a source of its own. Repeated rows are sampled each on their own, and rows
    are dealt out by id and text, so that one id with many texts fills no bucket; of rows with one id and size, the order of
    the texts' hashes decides. Rows that agree in both are in one bucket, which is sorted and not held. Columns
    of ``docs`` that bear a result's name are replaced. An empty table gives an empty result.
    """
    return set_aside(docs.drop(*RESULTS), INNER, lambda d: sampled(d, seed, weights, most))


def sampled(docs: DataFrame, seed: int, weights: tuple[int, ...], most: int) -> DataFrame:
    docs = docs.withColumn("size", word_count(F.col("text")))
    sizes = docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    sources = (
        cut(source_targets(sizes, weights, most))
        .withColumn("n_buckets", F.ceil(F.col("n_docs") / BUCKET_ROWS))
        .withColumn("step", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * ONE)).otherwise(0).cast("long"))
        .withColumn("step", F.least("step", F.lit(most * ONE)))
        .withColumn("start", hex_hash(F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))))
    )
    dealt = lookup(docs, sources, ["source"]).withColumn("bucket", F.pmod(hex_hash(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))), F.col("n_buckets")))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("source", "bucket", "step", "start").agg(F.count("*").alias("n"))
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("decimal(38,0)") * F.col("step") + F.col("start"))
    counts = cut(counts.select("source", "bucket", (F.col("base") % F.lit(ONE).cast("decimal(38,0)")).cast("long").alias("base")))
    end = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("size", "doc_id", F.xxhash64("text"))) * F.col("step") + F.col("base")
    return (
        lookup(dealt, counts, ["source", "bucket"])
        .withColumn("end", end)
        .withColumn("copies", (F.shiftright("end", 32) - F.shiftright(F.col("end") - F.col("step"), 32)).cast("int"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop(*INNER)
    )


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as often as they are taken."""
    def run(docs: DataFrame) -> DataFrame:
        taken = mix(docs).where("copies > 0")
        return taken.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop(*RESULTS, "__copy")

    return set_aside(docs, RESULTS, run).select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, count(*) AS n_docs, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight, source_size * 3 AS stop FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(stop) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level, row_number() OVER o AS place
      FROM w WINDOW o AS (ORDER BY stop::DOUBLE / weight, source IS NULL, source)),
t AS (SELECT *, least(stop::DOUBLE, coalesce((SELECT arg_min(level, place) FROM l WHERE level * weight <= stop) * weight, stop::DOUBLE)) AS target FROM l),
p AS (SELECT source, source_size, target, ceil(n_docs / 20000)::BIGINT AS n_buckets,
        CASE WHEN source_size > 0 THEN least(floor(target / source_size * 4294967296)::HUGEINT, 3 * 4294967296::HUGEINT) ELSE 0 END AS step,
        ('0x' || left(md5('0|' || coalesce('=' || source, '')), 8))::BIGINT AS start FROM t),
b AS (SELECT d.*, p.source_size, p.target, p.step, p.start, ('0x' || left(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 8))::BIGINT % n_buckets AS bucket
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY bucket, size, doc_id) * step + start AS e FROM b)
SELECT doc_id, size, source_size, target, ((e // 4294967296 - (e - step) // 4294967296) * size)::BIGINT AS taken FROM r
"""

QUERIES = {"op3_source_mix": op3_source_mix}
ORACLES = {"op3_source_mix": ORACLE}
