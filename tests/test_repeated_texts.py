"""What recurs in a table is read and searched once, and tables of molecules are not broadcast by the size of their texts' table."""

import importlib

import pytest
from pyspark.sql import functions as F

from moleweave.operators.molecules import each_text
from moleweave.plans import registry

#: Queries, and the function that does their work on each row of a table.
CASES = [
    ("regioisomer_parts", "plans.molecule_queries", "molecules"),
    ("murcko_text", "plans.molecule_queries", "molecules"),
    ("murcko_parsed", "plans.operator_queries", "molecules"),
    ("pattern_table", "operators.matching", "match_table"),
    ("stereo_texts", "plans.operator_queries", "molecules"),
    ("text_hashes", "plans.operator_queries", "molecules"),
    ("perceived_steps", "plans.operator_queries", "molecules"),
    ("mcs_complement", "plans.molecule_queries", "molecules"),
    ("stereo_centres", "plans.operator_queries", "molecules"),
    ("centres_between", "plans.operator_queries", "molecules"),
    ("bond_lookup_any", "plans.operator_queries", "bond_between"),
    ("common_patterns", "operators.matching", "common_parts"),
    ("common_parts", "plans.molecule_queries", "molecules"),
    ("reaction_similarity", "operators.reactions", "difference_fingerprint"),
]


@pytest.mark.parametrize(("name", "module", "function"), CASES)
def test_queries_work_once_on_each_text(spark, tmp_path, monkeypatch, name, module, function):
    """240 parts of two sizes make 2 to 50 texts, and the result is that of the SQL."""
    duckdb = pytest.importorskip("duckdb")
    spark.range(240).select(F.col("id").alias("p_partkey"), (F.col("id") % 2 + 3).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(9).select(F.col("id").cast("int").alias("n_nationkey")).write.parquet(f"{tmp_path}/nation.parquet")
    home, counts = importlib.import_module(f"moleweave.{module}"), []
    whole = getattr(home, function)

    def counted(df, *args, **more):
        counts.append(df.count())
        return whole(df, *args, **more)

    monkeypatch.setattr(home, function, counted)
    found = registry.queries()[name](spark, str(tmp_path))
    db = duckdb.connect()
    for table in ("part", "nation"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    expected = db.sql(registry.oracle_sql()[name])
    assert found.columns == expected.columns and sorted(map(tuple, found.collect())) == sorted(expected.fetchall())
    assert counts and max(counts) <= 50


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_each_text(spark, limit):
    """One, several or no rows for a text, null texts, repeated rows, and one text that most rows have; broadcast and salted."""
    rows = [(k, "a" if k % 9 else None if k % 2 else "b", k % 2) for k in range(200)] + [(1, "a", 1), (500, "none", 0)]
    df = spark.createDataFrame(rows, "id long, one string, two int")
    asked = []

    def run(texts):
        asked.append(sorted(map(str, texts.collect())))
        return texts.where("one is null or one <> 'none'").withColumn("n", F.explode(F.sequence(F.lit(0), F.coalesce(F.length("one"), F.lit(0)))))

    found = each_text(df, ["one", "two"], run, limit)
    assert len(asked[0]) == len(set(asked[0])) == 5 and found.columns == ["id", "one", "two", "n"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, found.collect())) == sorted(key((*r, n)) for r in rows if r[1] != "none" for n in range(len(r[1] or "") + 1))
    assert each_text(df.where("false"), ["one", "two"], run, limit).count() == 0


def test_features_are_not_broadcast_by_the_size_of_their_reactions(spark, tmp_path):
    """A reaction of many features comes from a short row, so what Spark expects of the features says nothing of them."""
    from moleweave.operators import reactions

    spark.createDataFrame([(k, "CCO>>CC=O") for k in range(3)], "id long, rxn string").write.parquet(f"{tmp_path}/rxn")
    change = reactions.difference_fingerprint(reactions.reactions(spark.read.parquet(f"{tmp_path}/rxn")), "id")
    found = reactions.tanimoto(change, spark.createDataFrame([(0, 1), (1, 2)], "a long, b long"), "id")
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.a, r.b): r.sim for r in found.collect()} == {(0, 1): 1, (1, 2): 1}


def test_bonds_are_not_broadcast_by_the_size_of_their_molecules(spark, tmp_path):
    from moleweave.operators.molecules import bond_between, bonds, molecules

    spark.createDataFrame([(k, "CCO") for k in range(3)], "id long, smiles string").write.parquet(f"{tmp_path}/texts")
    mols = molecules(spark.read.parquet(f"{tmp_path}/texts"))
    found = bond_between(mols.select("id", F.lit(2).alias("x"), F.lit(1).alias("y")), bonds(mols, "id"), "id")
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r.bond_idx for r in found.collect()] == [1] * 3


def test_few_molecules_of_a_batch_are_python_objects_at_once():
    """A batch of 1000 molecules of 40 atoms, nested columns that begin and end anywhere, and none."""
    import tracemalloc

    import pyarrow as pa

    from moleweave.functions.chemistry import mol_centres
    from moleweave.functions.molecules import mol_parse
    from moleweave.functions.slices import rows_of

    tracemalloc.start()
    mols = mol_parse.func(pa.array(["C" * 40] * 1000))
    found = mol_centres.func(mols.field("atoms"), mols.field("bonds"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(mols) == len(found) == 1000 and peak < 60e6
    some = pa.array([[k] * (k % 5) if k % 7 else None for k in range(1000)]).slice(3, 900)
    assert list(rows_of(some, some)) == [(x, x) for x in some.to_pylist()]
    assert len(mol_parse.func(pa.array([], pa.string()))) == 0
