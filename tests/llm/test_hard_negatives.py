import math
import random

import pytest

from moleweave.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, score string, v string"


def plain(rows, every=100):
    """Every pair of an anchor and a row, in Python's integers."""
    kept = {}
    for i, x, y, *_ in rows:
        if i is None or x is None or y is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        new = ((y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * c) for c in x])
        kept[i] = min(kept.get(i, new), new)
    out = []
    for a, (label, q) in kept.items():
        if a % every:
            continue
        score = {i: sum(p * r for p, r in zip(q, x)) for i, (_, x) in kept.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if kept[i][0] == label][:5]:
            fits = [i for i in order if kept[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fits[:5])]
    return sorted(out)


def mined(spark, rows, **how):
    return sorted(tuple(r) for r in H.hard_negatives(spark.createDataFrame(rows, SCHEMA), **how).collect())


@pytest.mark.parametrize("small", [True, False])
def test_against_every_pair(spark, monkeypatch, small):
    """Groups of near vectors, one large group of equal ones, and vectors without neighbours; in many small shards too."""
    if small:
        for name, value in (("SHARD_ROWS", 60), ("INTERVAL_ROWS", 7), ("ANCHORS", 5), ("PIVOTS", 6)):
            monkeypatch.setattr(H, name, value)
    rng = random.Random(4)
    unit = lambda: [rng.gauss(0, 0.3) for _ in range(8)]
    centres = [unit() for _ in range(12)]
    rows = [(k, [c + rng.gauss(0, 0.02) for c in centres[rng.randrange(12)]], rng.randrange(10), "", "") for k in range(500)]
    rows += [(k, centres[0], rng.choice([3, 3, 4]), None, "x") for k in range(500, 800)]
    rows += [(k, unit(), rng.randrange(10), None, None) for k in range(800, 1000)]
    found = mined(spark, rows, every=20)
    assert found == plain(rows, 20) and len(found) > 500


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [0.5, 0.5], 1, "", ""), (1, [0.5, 0.4], 1, "", ""), (2, [0.5, 0.4], 2, "", ""), (3, [0.5], 2, "", ""), (4, [], 2, "", ""), (5, [0.9, nan], 2, "", "")]
    rows += [(6, [inf, 0.0], 2, "", ""), (8, [None, 0.1], 2, "", ""), (9, None, 2, "", ""), (10, [0.5, 0.5], None, "", ""), (None, [0.5, 0.5], 2, "", "")]
    rows += [(2, [0.5, 0.4], 2, "", ""), (11, [0.5, 0.45], 3, "", ""), (11, [0.5, 0.39], 2, "", ""), (200, [-0.5, -0.5], 1, "", ""), (7, [-0.5, 0.5], 0, "", ""), (0, [0.0, 0.0], 9, "", "")]
    found = mined(spark, rows)
    assert found == plain(rows) and (100, 1, 1, 2, 128 * 128 + 102 * 128, 128 * 128 + 102 * 128) in found
    assert mined(spark, []) == [] and mined(spark, rows[1:3]) == []


def test_large_components_are_exact(spark):
    big = float(1 << 22)
    rows = [(0, [big, 3.0], 0, "", ""), (100, [big, 2.5], 1, "", ""), (1, [big, 1.0], 1, "", ""), (2, [big, 0.5], 5, "", ""), (3, [big, 0.25], 5, "", ""), (4, [1.0, 1.0], 5, "", "")]
    assert mined(spark, rows) == plain(rows)
