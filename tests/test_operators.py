import random
from itertools import product

from pyspark.sql import functions as F

from moleweave.functions.alignment import common_part
from moleweave.functions.graphs import formula, hybridizations, longest_rotatable, ring_systems, valence_problems, wiener
from moleweave.functions.smiles import molecule
from moleweave.operators import annotations, consensus, hashes, matching, reactions, rgroups
from moleweave.operators.molecules import atoms, highlight_regions, molecules, ring_atoms, with_atom_map


def mols(spark, *texts, sanitize=True):
    return molecules(spark.createDataFrame(list(enumerate(texts)), "id long, smiles string"), sanitize=sanitize)


def column(df, c):
    return [r.x for r in df.select("id", c.alias("x")).orderBy("id").collect()]


def test_molecule_rows_survive_bad_texts(spark):
    df = mols(spark, "CCO", None, "C(", "")
    assert [r.parse_ok for r in df.orderBy("id").collect()] == [True, False, False, False]
    assert atoms(df, "id").count() == 3
    assert column(df, wiener()) == [4, None, None, None] and column(df, F.size(ring_systems())) == [0] * 4
    assert mols(spark, "CC").where("id > 5").count() == 0


def test_graph_columns(spark):
    diazepam, chain = "CN1C(=O)CN=C(C2=C1C=CC(=C2)Cl)C3=CC=CC=C3", "CCC(CC(C)CC1CCC1)C(CC(=O)O)N"
    df = mols(spark, diazepam, chain, "CCCC", "CC(C)C", "[Na+].[Cl-]", "C1CC12CC2")
    assert column(df, ring_systems())[0] == [[14, 15, 16, 17, 18, 19], [1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12]]
    assert column(df, F.size(ring_systems(spiro=True)))[5] == 1 and column(df, F.size(ring_systems()))[5] == 2
    assert column(df, longest_rotatable())[1] == 8 and column(df, wiener()) == [726, 584, 10, 9, None, 14]
    assert column(df, formula())[0] == "C16H13ClN2O"
    assert ring_atoms(df.where("id = 0"), "id").count() == 19


def test_hybridization_and_problems(spark):
    df = mols(spark, "CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "CC#N", "F[P-](F)(F)(F)(F)F", "[Pt]")
    kinds = column(df, hybridizations())
    assert [i for i, k in enumerate(kinds[0]) if k == "SP3"] == [0, 12, 13]
    assert kinds[1] == ["SP3", "SP", "SP"] and kinds[2][1] == "SP3D2" and kinds[3] == ["UNSPECIFIED"]
    raw = mols(spark, "CN(C)(C)C", "C[N+](C)(C)C", "[Pt](Cl)(Cl)(N)N", "F[P-](F)(F)(F)(F)F", sanitize=False)
    assert column(raw, F.transform(valence_problems(), lambda p: p["atoms"][0])) == [[1], [], [], []]


def test_atom_numbers_and_regions(spark):
    df = mols(spark, "Cc1ccccc1")
    assert column(with_atom_map(df), F.transform("atoms", lambda a: a["map_num"])) == [[None, 1, 2, 3, 4, 5, 6]]
    assert column(with_atom_map(df, 1), F.transform("atoms", lambda a: a["map_num"]))[0][0] == 1
    regions = {r.region: (r.atom_idxs, r.bond_idxs) for r in highlight_regions(df, "id").collect()}
    assert regions == {"aromatic": ([1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6]), "other": ([0], [0])}


def test_dative_bonds(spark):
    bonds = column(matching.dative_bonds(mols(spark, "CN(C)(C)[Pt]", "[Pt]N(C)(C)C", "CN(C)[Pt]", "CN(C)(C)[Zn]", sanitize=False)), F.filter("bonds", lambda b: b["kind"] == "DATIVE"))
    assert [[(b.a, b.b) for b in x] for x in bonds] == [[(1, 4)], [(1, 0)], [], []]


def test_common_part_and_difference():
    found = common_part(molecule("FC1=CC=C2C(=C1)C=NN2"), molecule("CCC1=C2NN=CC2=CC(Cl)=C1"))
    assert set(range(10)) - set(found["left"]) == {0} and set(range(12)) - set(found["right"]) == {0, 1, 10} and found["n_bonds"] == 10
    assert common_part(molecule("C"), molecule("N"))["left"] == [] and not found["timed_out"]
    assert common_part(molecule("C" * 30), molecule("C" * 30), most=5)["timed_out"]


#: Inputs that the results are known for.
SCAFFOLDS = ["CCC1CC(CCC1=O)C(=O)C1=CC=CC(C)=C1", "CCC1CC(CCC1=O)C(=O)C1=CC=CC=C1", "CC(=C)C(C1=CC=CC=C1)S(=O)CC(N)=O", "CC1=CC(=CC=C1)C(C1CCC(N)CC1)C(F)(F)F", "CNC1CCC(C2=CC(Cl)=C(Cl)C=C2)C2=CC=CC=C12", "CCCOC(C1CCCCC1)C1=CC=C(Cl)C=C1"]


def test_scaffolds_and_their_mode(spark):
    found = hashes.with_murcko(mols(spark, *SCAFFOLDS), "scaffold")
    want = hashes.with_hash(mols(spark, "c1ccc(CC2CCCCC2)cc1", "c1ccccc1"), "canonical_smiles").orderBy("id").collect()
    texts = [r.scaffold for r in found.orderBy("id").collect()]
    assert texts.count(want[0].canonical_smiles) == 4 and texts[2] == want[1].canonical_smiles
    assert hashes.most_frequent(found, "scaffold").first().scaffold == want[0].canonical_smiles
    tied = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "v string")
    assert hashes.most_frequent(tied, "v").first().v == "a"


#: Inputs that the results are known for.
REGIO = ["CC1=CC2=C(C=C1)C(=CN2CCN1CCOCC1)C(=O)C1=CC=CC2=C1C=CC=C2", "CCCCCN1C=C(C2=CC=CC=C21)C(=O)C3=CC=CC4=CC=CC=C43", "CC1=CC=C(C(=O)C2=CN(CCN3CCOCC3)C3=C2C=CC=C3)C2=C1C=CC=C2", "CN1CCN(C(C1)CN2C=C(C3=CC=CC=C32)C(=O)C4=CC=CC5=CC=CC=C54)C"]


def test_regioisomers_and_where_their_parts_lie(spark):
    df = hashes.with_regioisomer(mols(spark, *REGIO), "regio")
    found = [r.regio for r in df.orderBy("id").collect()]
    assert [x == found[0] for x in found] == [True, False, True, False] and len(found[0].split(".")) == 6
    assert [r.id for r in hashes.same_hash(df.select("id", "regio"), df.where("id = 0"), "id", "regio").collect()] == [2]
    rows = hashes.fragment_cover(df, found[0], "id").collect()
    for i, smiles in ((0, REGIO[0]), (2, REGIO[2])):
        cover = [v for r in rows if r.id == i for v in r.atom_idxs]
        assert sorted(cover) == list(range(len(molecule(smiles)["atoms"]))) and sum(r.id == i for r in rows) == 6
    assert all(r.error for r in rows if r.id in (1, 3)) and sum(r.id in (1, 3) for r in rows) == 2


def test_all_hashes(spark):
    rows = hashes.hash_rows(mols(spark, "Cc1ccccc1", "C(", "C1CCCCC1C"), "id").collect()
    value = {(r.id, r.name): r.value for r in rows}
    assert len(rows) == 2 * (len(hashes.HASHES) + len(hashes.TEXT_HASHES))
    assert value[0, "mol_formula"] == "C7H8" and value[0, "murcko_scaffold"] == "c1ccccc1" and value[0, "anonymous_graph"] == value[2, "anonymous_graph"]
    assert value[0, "degree_vector"] == "0,1,5,1,0" and value[0, "small_world_br"] == "B7R1" and value[0, "regioisomer"] == "*C.c1ccccc1"


def test_rgroups(spark):
    core = "c1cc([*:1])ccc1[*:2]"
    df = mols(spark, "Cc1ccc(N)cc1", "CCOc1ccc(Cl)cc1", "O=C(O)c1ccc(OC)cc1", "Cc1ccccc1C", "CCO", "Cc1cc(C)c(N)cc1")
    groups = rgroups.decompose(df, core, "id")
    assert sorted(r.id for r in rgroups.unmatched(df, groups, "id").collect()) == [3, 4, 5]
    assert {r.label: r.n_fragments for r in rgroups.pool_sizes(groups).collect()} == {"R1": 3, "R2": 3}
    products = rgroups.enumerate_products(groups, ["R1", "R2"])
    assert products.count() == 9 and products.select("product").distinct().count() == 9
    texts = {r.product for r in products.collect()}
    assert {r.canonical_smiles for r in hashes.with_hash(df.where("id < 3"), "canonical_smiles").collect()} <= texts
    try:
        rgroups.enumerate_products(groups, ["R1", "R2"], most=8)
        raise AssertionError("not refused")
    except ValueError:
        pass
    order = spark.createDataFrame([("R10",), ("R2",), ("Rx",)], "label string").orderBy(rgroups.label_order(F.col("label")))
    assert [r.label for r in order.collect()] == ["R2", "R10", "Rx"]


def test_chains_on_a_core(spark):
    chains = spark.createDataFrame([("C" * n,) for n in range(1, 7)], "chain string")
    made = rgroups.attach_chains(spark.createDataFrame([("*[n+]1cc[nH]c1",)], "core string"), chains).collect()
    assert sorted(len(r.product) for r in made) == [len("C" * n + "[n+]1c[nH]cc1") for n in range(1, 7)]


def test_reactions(spark):
    text = "[cH1:1]1:[c:2](-[CH2:7]-[CH2:8]-[NH2:9]):[c:3]:[c:4]:[c:5]:[c:6]:1.[#6:11]-[CH1;R0:10]=[OD1]>>[c:1]12:[c:2](-[CH2:7]):[c:3]:1"
    rows = reactions.reactions(spark.createDataFrame([(1, text), (2, "CC"), (3, None), (4, ">>C")], "id long, rxn string")).orderBy("id").collect()
    assert [len(r.reactants) for r in rows] == [2, 0, 0, 0] and [r.rxn_ok for r in rows] == [True, False, False, True] and rows[3].products == ["C"]
    rxn = reactions.reactions(spark.createDataFrame([(1, "CCCO>>CCC=O"), (2, "CC(O)C>>CC(=O)C"), (3, "CCCO>>CCC"), (4, "NCCO>>NCC"), (5, "CCC>>CCCO")], "id long, rxn string"))
    assert [r.t for r in reactions.reversed_reactions(reactions.reversed_reactions(rxn)).select(reactions.reaction_text().alias("t")).collect()] == [r.rxn for r in rxn.collect()]
    change = reactions.difference_fingerprint(rxn, "id")
    pairs = spark.createDataFrame([(3, 4), (4, 3), (3, 3), (1, 2), (3, 5)], "a long, b long")
    sim = {(r.a, r.b): r.sim for r in reactions.tanimoto(change, pairs, "id").collect()}
    assert sim[3, 3] == 1 and sim[1, 2] == 0 and 0 < sim[3, 4] < 1 and sim[3, 4] == sim[4, 3] and sim[3, 5] == 1
    assert {(r.a, r.b): r.sim for r in reactions.tanimoto(change, pairs, "id", signed=True).collect()}[3, 5] == 0


def test_consensus_figures(spark):
    """The figures of a published table: coverage 0.653061, mcc 0.647150, sensitivity 0.625."""
    cells = [(1, 1)] * 5 + [(1, 0)] * 3 + [(0, 1)] + [(0, 0)] * 23
    rows = [(y, p, p, p) for y, p in cells] + [(1, 0, 1, 1)] * 16 + [(1, None, 1, 1)]
    df = spark.createDataFrame(rows, "y int, a int, b int, c int").withColumn("label", consensus.consensus(F.col("a"), F.col("b"), F.col("c")))
    r = consensus.covered_metrics(df, "y", "label").first()
    assert (r.n, r.covered, r.coverage, r.sensitivity, r.mcc) == (49, 32, 0.653061, 0.625, 0.64715)


def test_conflicts_and_splits(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), ("b", 1), (None, 1)], "k string, y int")
    assert [(r.k, r.n) for r in consensus.label_conflicts(df, "k", "y").collect()] == [("a", 2)]
    assert sorted(str(r.k) for r in consensus.without_conflicts(df, "k", "y").collect()) == ["None", "b", "b"]
    assert consensus.development(df, df.where("k = 'b'"), "k").count() == 3


def test_classifiers(spark):
    df = spark.createDataFrame([(float(i), float(i % 7), int(i > 50)) for i in range(100)], "x double, z double, y int")
    for model in consensus.fit_classifiers(df, ["x", "z"], "y").values():
        assert model.transform(df).where("prediction = y").count() > 95


def test_covers_against_all_choices():
    """The first choice in the order of fragments, or none, among all there are; many equal fragments are no trouble."""
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randint(2, 6)
        candidates = [sorted({tuple(sorted(rng.sample(range(n), rng.randint(1, min(3, n))))) for _ in range(rng.randint(1, 4))}) for _ in range(rng.randint(1, 4))]
        candidates = [[list(c) for c in each if len(c) == len(each[0])] for each in candidates]
        order = sorted(range(len(candidates)), key=lambda i: (len(candidates[i]), -len(candidates[i][0]), i))
        fits = [c for c in product(*(candidates[i] for i in order)) if sorted(v for x in c for v in x) == list(range(n))]
        want = dict(zip(order, fits[0], strict=True)) if fits else None
        assert hashes.cover(candidates, n) == (want and [want[i] for i in range(len(candidates))])
    pairs = [[i, i + 1] for i in range(59)]
    assert hashes.cover([pairs] * 30, 60) == [[2 * i, 2 * i + 1] for i in range(30)]
    assert hashes.cover([[p for p in pairs if 29 not in p]] * 30, 60) is None


def test_oxidations_differ_by_the_bond_that_changes(spark):
    """Three reactions in which a bond to oxygen becomes a double one: the changes of the first and second are alike."""
    rxn = reactions.reactions(spark.createDataFrame([(1, "CCO>>CC=O"), (2, "CC(O)C>>CC(=O)C"), (3, "NCCO>>NCC=O")], "id long, rxn string"))
    change = reactions.difference_fingerprint(rxn, "id")
    assert all(r.n > 0 for r in change.groupBy("id").agg(F.count("*").alias("n")).collect()) and change.where("count > 0").count() > 0
    sim = {(r.a, r.b): r.sim for r in reactions.tanimoto(change, spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long"), "id").collect()}
    assert 0 < sim[1, 3] < 1 and sim[1, 3] > sim[2, 3]


def test_hash_variants(spark):
    value = {(r.id, r.name): r.value for r in hashes.hash_rows(mols(spark, "CC(=O)CC", "CC(O)=CC", "C[NH3+]", "CN", "CCc1ccccc1"), "id").collect()}
    assert value[0, "het_atom_tautomer"] != value[2, "het_atom_tautomer"] and value[2, "het_atom_protomer"] == value[3, "het_atom_protomer"]
    assert value[2, "mesomer"].endswith("_1") and value[2, "redox_pair"] + "_1" == value[2, "mesomer"]
    assert value[4, "extended_murcko"] == "*c1ccccc1" and value[4, "arthor_substructure_order"] > value[3, "arthor_substructure_order"]


def test_perception_by_steps(spark):
    df = mols(spark, "C[CH]C=CC=C", "c1cccc1", "CN(C)(C)(C)C", sanitize=False)
    rows = annotations.with_perception(df).orderBy("id").collect()
    assert rows[0].radicals == [0, 1, 0, 0, 0, 0] and rows[0].conjugated == [2, 3, 4] and [r.failed_step for r in rows] == [None, "kekulize", "valence"]
    assert rows[1].ring_list == [[0, 1, 2, 3, 4]] or len(rows[1].ring_list[0]) == 5
    part = annotations.with_perception(df, annotations.HYBRIDIZATION).orderBy("id").first()
    assert part.hybrids[0] == "SP3" and part.radicals is None and part.conjugated is None and part.aromatic is None and part.ring_list is None


def test_more_products_than_one_task_should_make(spark):
    rows = [("Core", "C([*:1])([*:2])[*:3]")] + [(f"R{k}", f"{'C' * n}[*:{k}]") for k in (1, 2, 3) for n in range(1, 13)]
    made = rgroups.enumerate_products(spark.createDataFrame(rows, "label string, fragment string"), ["R1", "R2", "R3"])
    assert made.count() == 12 * 13 * 14 // 6


def test_mapped_reactions(spark):
    """Formed, broken and changed bonds by map numbers; unreadable templates and maps that do not fit are rows with an error."""
    from moleweave.operators.reactions import bond_changes, map_problems, reactions

    texts = ["[C:1](=[O:2])[OH:3].[N:4]>>[C:1](=[O:2])[N:4]", "[CH3:1][OH:2]>>[CH2:1]=[O:2]", "[C:1][C:1]>>[C:1]", "[C:1](>>[C:1]", "CC>>CC", "[C:1]-[C:2]-[C:3]>>[C:1]=[C:2].[C:3]", "no reaction", None, "[c:1]1[c:2]cccc1>>[C:1]1[C:2]CCCC1"]
    rxns = reactions(spark.createDataFrame(list(enumerate(texts)), "id long, rxn string"))
    changes = sorted(tuple(r) for r in bond_changes(rxns, "id").select("id", "map_a", "map_b", "before", "after", "change").collect())
    assert changes == [(1, 1, 2, "SINGLE", "DOUBLE", "changed"), (5, 1, 2, "SINGLE", "DOUBLE", "changed"), (5, 2, 3, "SINGLE", None, "broken"), (8, 1, 2, "AROMATIC", "SINGLE", "changed")]
    errors = {}
    for r in map_problems(rxns, "id").collect():
        errors.setdefault(r.id, set()).add(r.error)
    assert errors[0] == {"before: map 3 is on no other side"} and errors[2] == {"before: map 1 is there 2 times"}
    assert set(errors) == {0, 2, 3} and any("cannot be read" in e for e in errors[3]) and "after: map 1 is on no other side" in errors[3]
    turned = reactions(spark.createDataFrame([(0, "[CH2:1]=[O:2]>>[CH3:1][OH:2]")], "id long, rxn string"))
    assert bond_changes(turned, "id").first().change == "changed" and bond_changes(rxns.where("false"), "id").count() == 0
