"""Lookups give the same rows whether the small side is broadcast or both are dealt out, and are bounded by bytes."""

from pyspark.sql import functions as F

from moleweave.llm.common import lookup, total_bytes


def test_lookup_by_broadcast_and_by_salts(spark):
    big = spark.createDataFrame([(k % 3 or None, f"v{k}") for k in range(60)] + [(9, "none")], "k long, v string")
    small = spark.createDataFrame([(1, ["a", "b"]), (None, []), (2, None), (7, ["unused"])], "k long, x array<string>")
    for how in ("left", "inner"):
        found = [sorted(map(str, lookup(big, small, ["k"], how, limit=limit, salts=5).collect())) for limit in (1 << 20, 0)]
        assert found[0] == found[1] and len(found[0]) == (61 if how == "left" else 60)
    assert lookup(big, small.where("false"), ["k"], "left", limit=0).count() == 61


def test_bytes_follow_what_rows_hold(spark):
    df = spark.range(10).select(
        "id", F.repeat(F.lit("x"), 1000).alias("text"), F.sequence(F.lit(1), F.lit(500)).alias("numbers"), F.array_repeat(F.repeat(F.lit("y"), 100), 20).alias("texts"),
        F.create_map(F.lit(1), F.sequence(F.lit(1), F.lit(100)).cast("array<long>")).alias("lists"), F.lit(None).cast("string").alias("nothing"),
    )
    assert 10 * (8 + 1000 + 8 * 500 + 20 * 100 + 8 * 100) <= total_bytes(df) <= 20 * (8 + 1000 + 8 * 500 + 20 * 100 + 8 * 100)
    assert total_bytes(df.where("false")) == 0
