import random

import numpy as np
from pyspark.sql import functions as F

from moleweave.llm import near_duplicates as nd

SCHEMA = "doc_id long, text string, n long, node string"


def brute(rows, size, percent=80):
    sets, out = {}, {}
    for i, (_, text, *_) in enumerate(rows):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ")
        w = [x for x in w if x]
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out[i] = (rows[i][0], len(sets[i]), min(ids, default=None))
    return sorted(map(str, out.values()))


def found(spark, rows, size):
    result = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), size=size).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in result)
    return sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in result)


def test_components_against_all_pairs(spark):
    rng = random.Random(2)
    rows, k = [], 1000
    for _ in range(12):
        words = [f"v{rng.randint(0, 3000)}" for _ in range(rng.randint(30, 300))]
        for _ in range(rng.randint(1, 12)):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                copy[rng.randrange(len(copy))] = f"v{rng.randint(0, 3000)}"
            k -= 1
            rows.append((k, " ".join(copy), 0, ""))
    rows += [(5000, None, 0, ""), (5001, "", 0, ""), (5002, "One", 0, ""), (5003, "one", 0, ""), (5004, "É a b", 0, ""), (5005, "é a b", 0, ""), (None, rows[0][1], 0, ""), rows[3], (5006, "long " * 5000, 0, "")]
    for size in (4, 5):
        assert found(spark, rows, size) == brute(rows, size)


def test_group_around_a_text_with_members_too_far_from_each_other(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(150):
        copy = list(words)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(150)] = f"x{rng.randint(0, 200)}"
        rows.append((k, " ".join(copy), 0, ""))
    assert found(spark, rows, 4) == brute(rows, 4)


def test_what_meets_a_large_component_makes_few_pairs(spark, monkeypatch):
    """Copies of one text with up to eight words changed: those too far from all heads are compared by differences."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(150)]
    rows, made = [], []
    for k in range(600):
        copy = list(words)
        for _ in range(rng.randint(0, 8)):
            copy[rng.randrange(150)] = f"x{rng.randrange(3000)}"
        rows.append((k, " ".join(copy), 0, ""))
    for name in ("prefix_pairs", "expanded", "head_pairs"):
        def counted(*args, run=getattr(nd, name, None), **options):
            pairs = nd.settled(run(*args, **options))
            made.append(pairs.count())
            return pairs

        monkeypatch.setattr(nd, name, counted, raising=False)
    assert found(spark, rows, 4) == brute(rows, 4)
    assert 0 < sum(made) < 2 * len(rows), made


def test_differences_from_a_head_lose_no_pair(spark):
    """Every similar pair of guests, and of guests and members, that the head itself does not link is found."""
    rng = random.Random(5)
    base, texts, rows = [f"w{i}" for i in range(150)], [], []
    for k in range(160):
        copy = base[rng.choice((0, 0, 9)):]
        for _ in range(rng.randint(0, 3) if k < 40 else rng.randint(2, 7)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(8)}"
        texts.append((k, " ".join(copy)))
        rows.append((k, len({tuple(copy[i:i + 4]) for i in range(len(copy) - 3)}), 0 if k < 40 else k))
    sets = [{tuple(t.split()[i:i + 4]) for i in range(len(t.split()) - 3)} for _, t in texts]
    similar = lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    rows = spark.createDataFrame(rows, "node long, n long, comp long")
    guests = spark.createDataFrame([(0, k) for k in range(40, 160)], "host long, comp long")
    apart = nd.differences(rows, guests, spark.createDataFrame(texts, "node long, text string"), 4)
    head = apart.first().head
    near = {r.b for r in nd.near_heads(apart, 80).collect()}
    assert near == {k for k in range(40, 160) if similar(k, head)}
    labels = nd.settled(rows.select("node", F.when((F.col("comp") == 0) | F.col("node").isin(list(near)), 0).otherwise(F.col("comp")).alias("comp")))
    comp = {r.node: r.comp for r in labels.collect()}
    pairs = {(r.a, r.b) for r in nd.head_pairs(apart, labels, 80).collect()}
    wanted = {(i, j) for j in range(160) for i in range(j) if comp[i] != comp[j] and similar(i, j)}
    assert wanted <= pairs and len(wanted) > 30 and all(comp[i] != comp[j] for i, j in pairs)


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 2**63, 800).astype(np.uint64)
    a, b = (np.concatenate([shared, rng.integers(0, 2**63, 100).astype(np.uint64)]) for _ in "ab")
    s = nd.signatures(np.concatenate([a, b]), np.array([0, 900, 1800]), 240)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.1
    naive = [nd.permute32(((nd.mix64(a, 1) >> np.uint64(32)).astype(np.uint32) + np.uint32(k))).min() for k in range(240)]
    assert (s[0] == naive).all()


def test_recall_on_pairs_just_above_the_limit(spark):
    """Pairs of similarity 0.80 to 0.85, each over words of its own: all are found but for a few in a million."""
    rng = random.Random(12)
    rows, pairs = [], 0
    while pairs < 400:
        n = rng.randint(60, 200)
        words = [f"p{pairs}w{i}" for i in range(n)]
        copy = list(words)
        for _ in range(rng.randint(1, n // 25)):
            copy[rng.randrange(n)] = f"x{rng.random()}"
        a, b = ({tuple(w[k:k + 4]) for k in range(n - 3)} for w in (words, copy))
        if 0.80 <= len(a & b) / len(a | b) <= 0.85:
            rows += [(2 * pairs, " ".join(words), 0, ""), (2 * pairs + 1, " ".join(copy), 0, "")]
            pairs += 1
    result = {r.doc_id: r.component_id for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), size=4).collect()}
    assert sum(result[2 * k + 1] == 2 * k for k in range(pairs)) == pairs


def test_clusters_in_one_bucket_are_linked_round_by_round(spark):
    """Texts that share three quarters with all others, in clusters of near copies: every bucket holds several clusters."""
    rng = random.Random(3)
    common, rows = [f"c{i}" for i in range(150)], []
    for k in range(12):
        own = [f"k{k}w{i}" for i in range(36)]
        for j in range(12):
            copy = common + own
            copy[rng.randrange(len(copy))] = f"e{k}x{j}"
            rows.append((100 * k + j, " ".join(copy), 0, ""))
    assert found(spark, rows, 4) == brute(rows, 4)


def test_bitmaps_never_rule_out_similar_sets(spark):
    rng = random.Random(6)
    rows = []
    for k in range(150):
        n = rng.choice((5, 40, 300, 3000))
        words = [f"b{k}w{i}" for i in range(n)]
        copy = list(words)
        for _ in range(rng.randint(0, n // 40)):
            copy[rng.randrange(n)] = "y"
        rows += [(f"{k}a".encode(), " ".join(words)), (f"{k}b".encode(), " ".join(copy))]
    texts = spark.createDataFrame(rows, "node binary, text string")
    bits = nd.outlines(texts.select("node", F.size(nd.shingle_set(F.col("text"), 4)).cast("long").alias("n")), texts, 4, 80)
    k = lambda side: F.expr("substring(node, 1, length(node) - 1)") if side else F.col("node")
    a, b = (bits.withColumn("k", k(True)).where(F.col("node").cast("string").endswith(x)).select("k", *[F.col(c).alias(f"{c}_{x}") for c in bits.columns]) for x in "ab")
    kept = {bytes(r.k) for r in a.join(b, "k").where(nd.similar_bits(80)).collect()}
    sets = {node: {tuple(t.split()[i:i + 4]) for i in range(len(t.split()) - 3)} for node, t in rows}
    similar = {node[:-1] for node in sets if len(sets[node[:-1] + b"a"] & sets[node[:-1] + b"b"]) >= 0.8 * len(sets[node[:-1] + b"a"] | sets[node[:-1] + b"b"])}
    assert similar <= kept and len(similar) > 30


def outlined(spark, sets, percent):
    """Rows for the prefix join of sets of numbers, each a component of its own unless told otherwise."""
    counts = {}
    for s, _ in sets:
        for x in s:
            counts[x] = counts.get(x, 0) + 1
    rows = []
    for k, (s, comp) in enumerate(sets):
        order = sorted(s, key=lambda x: (counts[x], x))
        rows.append((k, len(s), comp, order[: len(s) - -(-percent * len(s) // 100) + 1]))
    return spark.createDataFrame(rows, "node long, n long, comp long, prefix array<long>")


def test_prefix_join_loses_no_pair_and_makes_few(spark):
    """Every similar pair of different components is found; of sets that share three quarters with all others none is."""
    rng = random.Random(8)
    sets = []
    for k in range(60):
        base = rng.sample(range(400), rng.choice([3, 12, 40, 90]))
        for _ in range(4):
            copy = set(base)
            for _ in range(rng.randint(0, len(base) // 6)):
                copy.discard(rng.choice(base))
                copy.add(rng.randrange(400))
            sets.append((copy, rng.choice([len(sets), k])))
    pairs = {frozenset(r) for r in nd.prefix_pairs(outlined(spark, sets, 80), 80).collect()}
    for i in range(len(sets)):
        for j in range(i):
            (x, c), (y, d) = sets[i], sets[j]
            if c != d and 100 * len(x & y) >= 80 * len(x | y):
                assert {i, j} in pairs, (x, y)
    assert all(sets[i][1] != sets[j][1] for i, j in map(tuple, pairs))
    alike = [(set(range(600)) | {1000 * k + i for i in range(1, 101)}, k) for k in range(1, 301)]
    one_group = [(set(range(690)) | {1000 * k + i for i in range(1, 11)}, 7) for k in range(1, 301)]
    assert nd.prefix_pairs(outlined(spark, alike, 80), 80).isEmpty() and nd.prefix_pairs(outlined(spark, one_group, 80), 80).isEmpty()


def test_stage_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text, 1, "a"), (2, text, 1, "a"), (2, text, 1, "a"), (9, "other " + text[:150], 1, "a"), (4, None, 1, "a"), (4, None, 1, "a")]
    stage = nd.near_dedup_stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert stage.columns == ["doc_id", "text", "n", "node"] and sorted(r.doc_id for r in stage.collect()) == [2, 4, 9]


def test_empty(spark):
    assert nd.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
