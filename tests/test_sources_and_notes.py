from pyspark.sql import functions as F

from moleweave.functions.register import register, register_pattern
from moleweave.operators import annotations
from moleweave.operators.molecules import molecules
from moleweave.sources import smiles_files
from moleweave.streaming.molecules import write_screened


def mols(spark, *texts, sanitize=True):
    return molecules(spark.createDataFrame(list(enumerate(texts)), "id long, smiles string"), sanitize=sanitize)


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.smi").write_text("CCO ethanol\n\n# remark\nC1=CC=CC=C1\tbenzene ring\nC( bad\n CC \n")
    rows = smiles_files.read_smiles(spark, f"file://{tmp_path}/in")
    assert sorted((r.smiles, r.name) for r in rows.where("name is not null").collect()) == [("C(", "bad"), ("C1=CC=CC=C1", "benzene ring"), ("CCO", "ethanol")]
    smiles_files.write_smiles(molecules(rows), f"file://{tmp_path}/out")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/out").collect()) == ["CC", "CCO ethanol", "c1ccccc1 benzene ring"]
    smiles_files.write_table(molecules(rows), f"file://{tmp_path}/table")
    assert spark.read.parquet(f"file://{tmp_path}/table").where("n_atoms = 6").count() == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.smi").write_text("CCO a\nCC b\nOC(=O)C c\nC( d\n")
    run = lambda: write_screened(smiles_files.read_smiles_stream(spark, f"file://{tmp_path}/in"), "[OX2H1]", f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination(120)
    assert run()
    (tmp_path / "in/b.smi").write_text("CO e\n")
    assert run()
    assert sorted(r.name for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["a", "c", "e"]


def test_sql_names(spark):
    register(spark)
    row = spark.sql("select mol_wiener(m.atoms.near) w, size(m.bonds) b from (select mol_parse('CCCC') m)").first()
    assert (row.w, row.b) == (10, 3)
    assert spark.sql("select count(*) n from (select inline(mol_parse('c1ccccc1').atoms)) where aromatic").first().n == 6


def test_charges_and_stereo(spark):
    rows = annotations.with_charges(mols(spark, "c1ncncc1C(=O)[O-]", "[Pt]", "C(")).orderBy("id").collect()
    assert min(rows[0].charges) in rows[0].charges[7:9] and rows[0].charge_notes[0] == f"{rows[0].charges[0]:.3f}"
    assert rows[1].charges == [None] and rows[2].charges == []
    r = annotations.with_stereo(mols(spark, "C/C=C/[C@H](N)O")).first()
    assert [x.label for x in r.double_bonds] == ["E"] and [x.atom for x in r.centres] == [3]


def test_problems(spark):
    df = mols(spark, "CN(C)(C)C", "c1cncc1", "CCO", "F[P-](F)(F)(F)(F)F.CN(C)C(F)=[N+](C)C", "CF(C)C", sanitize=False)
    found = {r.id: (r.failed_step, [list(p.atoms) for p in r.problems]) for r in annotations.with_problems(df).collect()}
    assert found[0] == ("valence", [[1]]) and found[1][0] == "kekulize" and found[2] == found[3] == (None, []) and found[4][0] == "valence"
    partial = annotations.with_problems(df, annotations.KEKULIZE | annotations.HYBRIDIZATION)
    assert [r.failed_step for r in partial.orderBy("id").collect()] == [None, "kekulize", None, None, None]


def test_abbreviations(spark):
    df = mols(spark, "COc1ccc(C(=O)[O-])cc1", "c1c[nH]cc1C(F)(F)F", "CC", "FC(F)(F)c1cccc(C(F)(F)F)c1")
    of = lambda rows, i: sorted((r.label, r.anchor, r.atoms) for r in rows if r.id == i)
    found = annotations.abbreviations(df, "id").collect()
    assert of(found, 0) == [("CO2-", 5, [6, 7, 8]), ("OMe", 2, [0, 1])] and of(found, 1) == [] and of(found, 2) == [] and len(of(found, 3)) == 2
    assert of(annotations.abbreviations(df, "id", most_coverage=0.8).collect(), 1) == [("CF3", 4, [5, 6, 7, 8])]
    assert df.where(F.col("id") > 9).count() == 0


def test_names_of_hashes_and_tables_in_sql(spark):
    register(spark)
    assert [r.symbol for r in spark.sql("SELECT symbol FROM mol_atoms('CCO') ORDER BY idx").collect()] == ["C", "C", "O"]
    rows = spark.sql("SELECT s, count(*) AS n FROM VALUES ('C1CC1'), ('C('), ('CO') AS t(s), LATERAL mol_bonds(s) GROUP BY s").collect()
    assert {r.s: r.n for r in rows} == {"C1CC1": 3, "CO": 1}
    assert spark.sql("SELECT mol_hash('OCC', 'canonical_smiles') = mol_hash('CCO', 'canonical_smiles') AS same, mol_hash('CC[O-]', 'net_charge') AS q").first() == (True, "-1")
    register_pattern(molecules(spark.createDataFrame([("CCO",), ("CC",)], "smiles string")), "alcohols", "[OX2H]")
    assert [r.n for r in spark.sql("SELECT size(matches) AS n FROM alcohols ORDER BY n").collect()] == [0, 1]
