"""Consensus of classifiers and the figures that describe it, conflicts of labels, and disjoint splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INCONCLUSIVE = "inconclusive"


def consensus(*votes: Column) -> Column:
    """The label that all give, as text, else ``inconclusive``, also where a vote is null."""
    same = reduce(lambda a, b: a & b, [v == votes[0] for v in votes[1:]], votes[0].isNotNull())
    return F.when(same, votes[0].cast("string")).otherwise(INCONCLUSIVE)


def covered_metrics(df: DataFrame, truth: str, label: str) -> DataFrame:
    """n, covered, tp, fp, fn, tn, coverage, sensitivity and mcc over labels 0 and 1; only conclusive rows are scored."""
    count = lambda *tests: F.sum(F.when(reduce(lambda a, b: a & b, tests), 1).otherwise(0)).cast("long")
    said, true = lambda x: F.col(label) == str(x), lambda x: F.col(truth) == x
    cells = df.agg(
        F.count("*").alias("n"), count(F.col(label) != INCONCLUSIVE).alias("covered"),
        count(said(1), true(1)).alias("tp"), count(said(1), true(0)).alias("fp"), count(said(0), true(1)).alias("fn"), count(said(0), true(0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    ratio = lambda a, b: F.round(F.when(b != 0, a / b), 6)
    return cells.select("*", ratio(F.col("covered").cast("double"), F.col("n")).alias("coverage"), ratio(tp, tp + fn).alias("sensitivity"), ratio(tp * tn - fp * fn, root).alias("mcc"))


def wilson(share: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share among ``n``."""
    root = z * F.sqrt(share * (1 - share) / n + z * z / 4 / (n * n))
    return (share + z * z / 2 / n - root) / (1 + z * z / n), (share + z * z / 2 / n + root) / (1 + z * z / n)


def label_conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """(key, n): keys that carry several labels, with their rows; labels are summed up before the shuffle."""
    found = df.groupBy(key).agg(F.count("*").alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi"))
    return found.where("lo <> hi").select(key, "n")


def without_conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """The rows whose key carries one label."""
    return df.join(label_conflicts(df, key, label).select(key), key, "left_anti")


def development(df: DataFrame, external: DataFrame, key: str) -> DataFrame:
    """Rows whose key no external row has, so that the two sets are disjoint; rows without a key are kept."""
    return df.join(external.select(key).distinct(), key, "left_anti")


def fit_classifiers(train: DataFrame, features: list[str], label: str, seed: int = 7) -> dict:
    """A gradient-boosted and a random-forest pipeline over numeric columns, fitted by Spark ML and saved like any pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    gather = VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="keep")
    args = {"labelCol": label, "featuresCol": "__features", "seed": seed}
    kinds = {"boosted": GBTClassifier(maxIter=20, **args), "forest": RandomForestClassifier(numTrees=50, **args)}
    return {name: Pipeline(stages=[gather, kind]).fit(train) for name, kind in kinds.items()}


def evaluate_once(model, external: DataFrame, truth: str, path: str) -> DataFrame:
    """Score a frozen model on the external set and write its figures; a path that holds figures already is an error."""
    scored = model.transform(external).withColumn("__label", F.col("prediction").cast("int").cast("string"))
    covered_metrics(scored, truth, "__label").write.mode("error").parquet(path)
    return external.sparkSession.read.parquet(path)
