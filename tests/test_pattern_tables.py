"""A table of patterns over a table of molecules gives what each pattern gives as a column, in the same order."""

import random

from moleweave.functions import smarts
from moleweave.functions.register import register
from moleweave.functions.smiles import molecule
from moleweave.operators.matching import match_table, read_patterns
from moleweave.operators.molecules import molecules

SMILES = [
    "CCO", "CC(=O)OC", "c1ccccc1C(=O)O", "C1CC1CN", "CC#N", "c1ccc2[nH]ccc2c1", "[Na+].[Cl-]", "C[N+](C)(C)C", "O=C1C=CC(=O)N1", "FC(F)(F)c1ccncc1", "C/C=C/C(=O)N", "[13CH4]", "CC(C)(C)c1ccc(O)cc1", "S(=O)(=O)(N)c1ccccc1",
    "C1CCC2(CC1)CCCC2", "bad(", None, "*CC*", "[Pt](Cl)(Cl)(N)N", "OCC1OC(O)C(O)C(O)C1O",
]
PATTERNS = [
    "C", "CC", "C(=O)[OX2]", "[#6]~[#7]", "c1ccccc1", "[$(*#*)]", "[!$(*#*)&!D1]-&!@[!$(*#*)&!D1]", "[r{5-6}]", "[R0]", "[D3]", "[X4]", "[v4]", "[x2]", "[CH3]", "[nH]", "[+1]", "[-]", "[13C]", "*", "a", "A", "C.C", "[C,N]=O", "[#6;R;!$(C=O)]",
    "C1CC1", "[OX2H]", "cO", "C!@C", "C@C", "[Pt]", "[Xe]", "N[C;H2]", "[R2]", "c:n", "[#6]-,=[#8]", "[H4]",
]


def columns(spark, mols):
    out = {}
    for k, text in enumerate(PATTERNS):
        for r in mols.select("id", smarts.matches(text).alias("m")).where("size(m) > 0").collect():
            out[r.id, k] = r.m
    return out


def test_rows_match_as_columns_do(spark):
    """Every pattern in every molecule, by columns and by the rows of the parsed molecule, copies of atoms sets included or not."""
    mols = molecules(spark.createDataFrame(list(enumerate(SMILES)), "id long, smiles string")).cache()
    expected = columns(spark, mols)
    for k, text in enumerate(PATTERNS):
        p = smarts.pattern(text)
        for i, smiles in enumerate(SMILES):
            assert smarts.row_matches(p, molecule(smiles)) == expected.get((i, k), []), (smiles, text)
    every = mols.select("id", smarts.matches("CC", uniquify=False).alias("m")).collect()
    assert all(smarts.row_matches(smarts.pattern("CC"), molecule(SMILES[r.id]), uniquify=False) == r.m for r in every)


def test_tables_of_patterns(spark, monkeypatch):
    """A thousand patterns from a table, texts that are none among them, in small groups."""
    from moleweave.operators import matching

    monkeypatch.setattr(matching, "PATTERNS", 7)
    rng = random.Random(2)
    mols = molecules(spark.createDataFrame(list(enumerate(SMILES)), "id long, smiles string")).cache()
    expected = columns(spark, mols)
    drawn = [(f"p{k}", rng.randrange(len(PATTERNS))) for k in range(1000)]
    rows = [(name, PATTERNS[k]) for name, k in drawn] + [("bad", "C("), ("none", None), ("worse", "[Q")]
    patterns = spark.createDataFrame(rows, "name string, smarts string")
    found = {(r.id, r.name): r.matches for r in match_table(mols, patterns, "id", "name").collect()}
    assert found == {(i, name): m for name, k in drawn for i in range(len(SMILES)) if (m := expected.get((i, k)))}
    errors = {r.name: r.pattern_error for r in read_patterns(patterns).where("pattern_error is not null").collect()}
    assert set(errors) == {"bad", "none", "worse"}
    assert match_table(mols, patterns.where("false"), "id", "name").count() == 0 and match_table(mols.where("false"), patterns, "id", "name").count() == 0


def test_what_patterns_need_is_in_what_they_match():
    for text in PATTERNS:
        p = smarts.pattern(text)
        for smiles in SMILES:
            m = molecule(smiles)
            if smarts.row_matches(p, m):
                has = {str(a["z"]) for a in m["atoms"]} | {"-".join(map(str, sorted((m["atoms"][b["a"]]["z"], m["atoms"][b["b"]]["z"])))) for b in m["bonds"]}
                assert set(smarts.needs(p)) <= has


def test_in_sql(spark):
    register(spark)
    row = spark.sql("select mol_matches('CC(=O)OC', 'C(=O)[OX2]') a, mol_match('CCO', 'CO') b, mol_match('CC', 'N') c, mol_matches('CC', 'C(') d, mol_matches('C(', 'C') e").first()
    assert row.a == [[1, 2, 3]] and row.b == [1, 2] and row.c is None and row.d is None and row.e is None
