"""The operators' relational parts over the given tables: consensus figures, conflicts of labels, splits and similarity.

These show the algebra; no molecules are in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moleweave.operators import consensus
from moleweave.operators.reactions import tanimoto


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars"), "doc_id")


def lift_consensus(spark, sf_dir):
    """Three voters on toxicity: quality, length and language."""
    votes = F.col("quality"), (F.col("n_chars") > 2000).cast("int"), (F.col("lang") == "en").cast("int")
    return consensus.covered_metrics(labelled(spark, sf_dir).withColumn("label", consensus.consensus(*votes)), "toxic", "label")


def lift_wilson(spark, sf_dir):
    shares = labelled(spark, sf_dir).groupBy("lang").agg(F.count("*").cast("double").alias("n"), F.avg(F.col("quality").cast("double")).alias("p"))
    lo, hi = consensus.wilson(F.col("p"), F.col("n"))
    return shares.select("lang", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


def lift_label_conflict(spark, sf_dir):
    """The first word stands in for a structure's key."""
    keyed = labelled(spark, sf_dir).withColumn("k", F.split(F.lower(F.btrim("text")), " ")[0])
    return consensus.label_conflicts(keyed, "k", "quality")


def lift_split_disjoint(spark, sf_dir):
    """Documents whose text none of the external fifth has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("k1"), F.md5("text").alias("k2"), "text")
    keyed = docs.withColumn("key", F.when(F.col("text").isNotNull(), F.concat("k2", F.col("k1").cast("string"))))
    return consensus.development(keyed.where("doc_id % 5 <> 0"), keyed.where("doc_id % 5 = 0 and key is not null"), "key").where("text is not null").select("doc_id")


def lift_tanimoto(spark, sf_dir):
    """Event-type counts of each user and the next one."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("feature")).agg(F.count("*").alias("count"))
    users = counts.select("user_id").distinct()
    pairs = users.select(F.col("user_id").alias("a"), (F.col("user_id") + 1).alias("b")).join(users.select(F.col("user_id").alias("b")), "b", "left_semi")
    return tanimoto(counts, pairs.select("a", "b"), "user_id").select("a", "b", F.round("sim", 6).alias("sim"))


QUERIES = {"lift_consensus": lift_consensus, "lift_wilson": lift_wilson, "lift_label_conflict": lift_label_conflict, "lift_split_disjoint": lift_split_disjoint, "lift_tanimoto": lift_tanimoto}

ORACLES = {
    "lift_consensus": "WITH v AS (SELECT l.toxic AS y, l.quality AS a, CAST(d.n_chars > 2000 AS INTEGER) AS b, CAST(d.lang = 'en' AS INTEGER) AS c FROM labels l JOIN documents d ON l.doc_id = d.doc_id), q AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE a = b AND b = c) AS BIGINT) AS covered, CAST(count(*) FILTER (WHERE a = b AND b = c AND a = 1 AND y = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE a = b AND b = c AND a = 1 AND y = 0) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE a = b AND b = c AND a = 0 AND y = 1) AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE a = b AND b = c AND a = 0 AND y = 0) AS BIGINT) AS tn FROM v) SELECT n, covered, tp, fp, fn, tn, round(CAST(covered AS DOUBLE) / n, 6) AS coverage, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS sensitivity, round((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS mcc FROM q",
    "lift_wilson": "WITH t AS (SELECT d.lang, CAST(count(*) AS DOUBLE) AS n, avg(CAST(l.quality AS DOUBLE)) AS p FROM labels l JOIN documents d USING (doc_id) GROUP BY d.lang) SELECT lang, round((p + 1.9208 / n - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) AS lo, round((p + 1.9208 / n + 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) AS hi FROM t",
    "lift_label_conflict": "SELECT split_part(lower(trim(d.text)), ' ', 1) AS k, CAST(count(*) AS BIGINT) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY 1 HAVING count(DISTINCT l.quality) > 1",
    "lift_split_disjoint": "SELECT d.doc_id FROM documents d WHERE d.doc_id % 5 <> 0 AND d.text NOT IN (SELECT text FROM documents WHERE doc_id % 5 = 0 AND text IS NOT NULL)",
    "lift_tanimoto": "WITH f AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2), s AS (SELECT user_id, sum(c) AS t FROM f GROUP BY 1), m AS (SELECT x.user_id AS a, y.user_id AS b, sum(least(x.c, y.c)) AS mn FROM f x JOIN f y ON x.event_type = y.event_type AND y.user_id = x.user_id + 1 GROUP BY 1, 2) SELECT p.user_id AS a, q.user_id AS b, round(CAST(coalesce(mn, 0) AS DOUBLE) / (p.t + q.t - coalesce(mn, 0)), 6) AS sim FROM s p JOIN s q ON q.user_id = p.user_id + 1 LEFT JOIN m ON m.a = p.user_id AND m.b = q.user_id",
}
