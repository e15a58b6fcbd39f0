"""Texts of molecules that cannot be are refused with their reason; pairing and distances hold at any size."""

import itertools
import random
import time

import numpy as np
import pytest

from moleweave.functions import pairing
from moleweave.functions.graphs import distances
from moleweave.functions.smiles import molecule
from moleweave.operators.annotations import with_perception, with_problems
from moleweave.operators.molecules import molecules


@pytest.mark.parametrize(
    "text,reason",
    [("c1cccc1", "alternating"), ("c1cccn1", "alternating"), ("CN(C)(C)(C)C", "valence 5 of atom 1, N"), ("C(C)(C)(C)(C)C", "valence 5"), ("CN(=O)=O", "valence 5"), ("CO(C)C", "valence 3"), ("F(C)C", "valence 2"), ("[CH5]", "valence 5"), ("Cl(=O)(=O)(=O)O", "valence 7")],
)
def test_refused_when_sanitising_alone(text, reason):
    m = molecule(text)
    assert not m["parse_ok"] and reason in m["error"] and not m["atoms"] and molecule(text, sanitize=False)["parse_ok"]


@pytest.mark.parametrize(
    "text",
    ["c1ccccc1", "c1ccc2ccccc2c1", "c1ccoc1", "c1cc[nH]c1", "Cn1cccc1", "c1ccn2cccc2c1", "*1cccc*1", "O=c1cc[nH]cc1", "C[N+](C)(C)C", "[O-][n+]1ccccc1", "c1ccsc1", "CP(C)(C)(C)C", "FS(F)(F)(F)(F)F", "CS(=O)(=O)C", "O=[N+]([O-])C", "[C-]#[O+]", "F[P-](F)(F)(F)(F)F", "[BH4-]", "[Pt](Cl)(Cl)(N)N", "c1cc*cc1", "C*(C)(C)(C)C", "n1c[nH]cc1", "c1ccc2c(c1)[nH]c1ccccc12", "[NH4+]", "O=S(=O)(O)O", "CI(Cl)Cl"],
)
def test_let_pass_when_sanitising(text):
    assert molecule(text)["parse_ok"], molecule(text)["error"]


def largest(near):
    """Size of the largest matching, by trying everything."""
    def go(left):
        if not left:
            return 0
        v = min(left)
        rest = left - {v}
        return max([go(rest)] + [1 + go(rest - {w}) for w in near[v] if w in rest])

    return go(frozenset(near))


def matched(near, start):
    mate = pairing.paired(near) if start else {}
    for v in sorted(near):
        if v not in mate:
            pairing.improve(near, mate, v, set())
    assert all(mate[mate[v]] == v and mate[v] in near[v] for v in mate)
    return len(mate) // 2


def test_pairing_is_largest_in_random_graphs():
    rng = random.Random(1)
    for k in range(800):
        n, share = rng.randint(2, 10), rng.choice([0.15, 0.3, 0.5])
        near = {v: [] for v in range(n)}
        for a, b in itertools.combinations(range(n), 2):
            if rng.random() < share:
                near[a].append(b)
                near[b].append(a)
        assert matched(near, k % 2) == largest(near)


def test_pairing_of_large_rings_and_cages():
    """Rings of ten thousand atoms, and odd cages: rings of five and six atoms like those of a ball, one atom short."""
    began = time.process_time()
    for n in (10_000, 10_001):
        assert matched({v: [(v - 1) % n, (v + 1) % n] for v in range(n)}, True) == n // 2
    rows, width = 30, 40
    place = lambda i, j: i * width + j % width
    near = {place(i, j): [] for i in range(rows) for j in range(width)}
    for i, j in itertools.product(range(rows), range(width)):
        for w in [place(i, j + 1)] + ([place(i + 1, j)] if i + 1 < rows and (i + j) % 2 == 0 else []):
            near[place(i, j)].append(w)
            near[w].append(place(i, j))
    for w in near.pop(7):
        near[w].remove(7)
    assert matched(near, True) == matched(near, False) == len(near) // 2
    assert time.process_time() - began < 10


def test_large_rings_fail_no_job(spark):
    texts = ["c1c" + "c" * 2998 + "1", "c1c" + "c" * 2999 + "1", "CN(C)(C)(C)C", "CCO"]
    mols = molecules(spark.createDataFrame(list(enumerate(texts)), "id long, smiles string"), sanitize=False).select("id", "parse_ok", "error", "atoms", "bonds", "rings").cache()
    found = {r.id: r for r in with_problems(mols).collect()}
    assert [found[k].failed_step for k in range(4)] == [None, "kekulize", "valence", None] and len(found[1].problems[0].atoms) == 1
    assert [r.failed_step for r in with_perception(mols.where("id > 1")).orderBy("id").collect()] == ["valence", None]
    strict = {r.id: r for r in molecules(spark.createDataFrame(list(enumerate(texts)), "id long, smiles string")).collect()}
    assert [strict[k].parse_ok for k in range(4)] == [True, False, False, True] and strict[2].error == "valence 5 of atom 1, N, is too large"


def test_distances_of_random_and_long_molecules():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randint(0, 25)
        edges = {(a, b) for a in range(n) for b in range(a) if rng.random() < 0.09}
        expected = np.full((n, n), 10**6)
        np.fill_diagonal(expected, 0)
        for a, b in edges:
            expected[a, b] = expected[b, a] = 1
        for k in range(n):
            expected = np.minimum(expected, expected[:, k : k + 1] + expected[k : k + 1])
        expected[expected >= 10**6] = -1
        assert (distances([[{"v": b if a == v else a} for a, b in edges if v in (a, b)] for v in range(n)]) == expected).all()
    began = time.process_time()
    n = 2000
    found = distances([[{"v": w} for w in (v - 1, v + 1) if 0 <= w < n] for v in range(n)])
    assert (found == abs(np.arange(n)[:, None] - np.arange(n)[None])).all() and time.process_time() - began < 10
