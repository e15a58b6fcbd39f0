"""The largest common part is exact, can stop and go on anywhere, and is dealt out by Spark without a limit."""

import itertools
import random
import time

from pyspark.sql import functions as F

from moleweave.functions.alignment import NONE, START, Search, common_part, common_pattern, packed, unpacked
from moleweave.functions.smiles import molecule
from moleweave.operators.matching import common_parts, with_matches
from moleweave.operators.molecules import molecules


def random_molecule(rng, n):
    pairs = [(rng.randrange(i), i) for i in range(1, n)]
    pairs += [p for p in itertools.combinations(range(n), 2) if p not in pairs and rng.random() < 0.2]
    atoms = [{"z": rng.choice([6, 6, 7]), "near": []} for _ in range(n)]
    for k, (a, b) in enumerate(pairs):
        atoms[a]["near"].append({"v": b, "k": k})
        atoms[b]["near"].append({"v": a, "k": k})
    return {"atoms": atoms, "bonds": [{"a": a, "b": b, "idx": k, "kind": rng.choice(["SINGLE", "SINGLE", "DOUBLE"])} for k, (a, b) in enumerate(pairs)]}


def brute(a, b):
    """Bonds and atoms of the largest part, by going through all mappings that hang together by common bonds."""
    za, zb = ([x["z"] for x in m["atoms"]] for m in (a, b))
    ka, kb = ({frozenset((x["a"], x["b"])): x["kind"] for x in m["bonds"]} for m in (a, b))
    best, seen = (0, 0), set()
    todo = [frozenset({(v, y)}) for v in range(len(za)) for y in range(len(zb)) if za[v] == zb[y]]
    while todo:
        m = todo.pop()
        if m in seen:
            continue
        seen.add(m)
        best = max(best, (sum(ka.get(frozenset((v, w)), 0) == kb.get(frozenset((y, x)), 1) for (v, y), (w, x) in itertools.combinations(m, 2)), len(m)))
        lefts, rights = {v for v, _ in m}, {y for _, y in m}
        for (v, y), (e, kind), (f, other) in itertools.product(m, ka.items(), kb.items()):
            if v in e and y in f and kind == other:
                (w,), (x,) = e - {v}, f - {y}
                if w not in lefts and x not in rights and za[w] == zb[x]:
                    todo.append(m | {(w, x)})
    return best


def test_against_all_mappings_of_random_graphs():
    rng = random.Random(3)
    for _ in range(200):
        a, b = random_molecule(rng, rng.randint(1, 7)), random_molecule(rng, rng.randint(1, 7))
        found, expected = common_part(a, b), brute(a, b)
        assert (found["n_bonds"], len(found["left"])) == expected
        search, best, left = Search(a, b), NONE, [START]
        while left:
            best, left = search.run([unpacked(packed(s)) for s in left], best, rng.randint(1, 9))
        assert (max(0, best[0][0]), max(0, best[0][1])) == expected


def test_chains_of_any_length_and_early_ends():
    began = time.process_time()
    found = common_part(molecule("C" * 700), molecule("C" * 700))
    assert found["n_bonds"] == 699 and not found["timed_out"] and time.process_time() - began < 30
    assert common_part(molecule("C" * 30), molecule("C" * 30), most=5)["timed_out"] and common_part(molecule(""), molecule("C"))["left"] == []


def test_rounds_in_spark_give_what_one_search_gives(spark):
    """Searches of few states a round, over random pairs, pairs without a common atom, and texts that cannot be read."""
    rng = random.Random(5)
    texts = ["CC(O)c1ccccc1", "CCOC(C)=O", "C1CC2CCC1C2", "NCC1CC1CO", "c1ccncc1C", "FC(F)(F)F", "bad(", "O", "CC(C)(C)CC", "OC1CCCCC1N", None]
    rows = [(k, rng.choice(texts), rng.choice(texts)) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, one string, two string")
    one = molecules(df, "one").select("id", "atoms", "bonds")
    pairs = one.join(molecules(df, "two").select("id", "atoms", "bonds").withColumnsRenamed({"atoms": "b_atoms", "bonds": "b_bonds"}), "id")
    found = {r.id: r for r in common_parts(pairs, "id", most=15).collect()}
    assert len(found) == len(rows)
    for k, x, y in rows:
        a, b = molecule(x), molecule(y)
        whole = common_part(a, b, None)
        assert (found[k].n_bonds, len(found[k].left)) == (whole["n_bonds"], len(whole["left"])), (x, y)
        assert found[k].pattern == common_pattern(a, b, found[k].left, found[k].right)
    assert common_parts(pairs.where("false"), "id").count() == 0


def test_molecules_are_not_broadcast_by_the_size_of_their_texts(spark, tmp_path):
    spark.createDataFrame([(k, "CCO" * 9) for k in range(3)], "id long, text string").write.parquet(f"{tmp_path}/texts")
    one = molecules(spark.read.parquet(f"{tmp_path}/texts"), "text")
    pairs = one.select("id", "atoms", "bonds", F.col("atoms").alias("b_atoms"), F.col("bonds").alias("b_bonds"))
    found = common_parts(pairs, "id", most=15)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r.n_bonds for r in found.collect()] == [26] * 3


def test_patterns_match_both_molecules(spark):
    pairs = [("CC(O)c1ccccc1", "Cc1ccc(O)cc1"), ("FC1=CC=C2C(=C1)C=NN2", "CCC1=C2NN=CC2=CC(Cl)=C1"), ("CC(=O)OCC", "CCC(=O)OC"), ("C1CC1CO", "OCCC1CC1")]
    for x, y in pairs:
        a, b = molecule(x), molecule(y)
        found = common_part(a, b)
        pattern = common_pattern(a, b, found["left"], found["right"])
        hits = with_matches(molecules(spark.createDataFrame([(x,), (y,)], "smiles string")), pattern).collect()
        assert all(r.matches and len(r.matches[0]) == len(found["left"]) for r in hits), pattern
