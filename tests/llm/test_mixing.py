import random

from moleweave.llm.mixing import mix, mixing_stage, source_targets

SCHEMA = "doc_id long, text string, source string, size string"


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        stop = [s for s in free if level * weight[s] > most * sizes[s]]
        if not stop:
            return out | {s: level * weight[s] for s in free}
        for s in stop:
            out[s] = most * sizes[s]
            left -= out[s]
            free.discard(s)


def test_targets_against_resharing(spark):
    rng = random.Random(3)
    for k in range(6):
        sizes = {s: rng.choice([0, 1, 10, 500, 10_000]) for s in [None, "", "a", "B", "é", "z", "zz"][: rng.randint(1, 7)]}
        found = source_targets(spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, n_docs long, source_size long"))
        expected = targets(sizes)
        for r in found.collect():
            assert abs(r.target - expected[r.source]) < 1e-6 * max(1, expected[r.source]), (k, sizes)


def test_mix_is_near_target_whole_and_repeatable(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(1, 60)), rng.choice(["a"] * 6 + ["b", "c", None]), "clash") for i in range(3000)]
    rows += [(1, None, "a", ""), (None, "", "b", ""), (None, "x y", None, ""), (7, rows[7][1], rows[7][2], "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    first, again = (sorted(map(str, mix(d).select("doc_id", "size", "source", "taken").collect())) for d in (docs, docs.repartition(7)))
    assert first == again and len(first) == len(rows)
    found = mix(docs).collect()
    total = {}
    for r in found:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r["size"] and r["size"] == len((r.text or "").split())
        total.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(taken - target) <= 0.02 * target + 120 for taken, target in total.values())
    stage = mixing_stage(spark, docs, "")
    assert stage.columns == docs.columns and stage.count() == sum(r.copies for r in found)


def test_empty(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ties_of_one_id_are_taken_alike_in_every_run(spark):
    """Texts of equal size under one id, and without an id, in any order and number of partitions."""
    rows = [(k % 3 or None, f"a b c{k}", f"s{k % 2}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted((str(r.doc_id), r.text, r.copies) for r in mix(docs.orderBy(*order).repartition(n)).collect()) for n, order in ((1, ["text"]), (5, ["source", "text"]), (3, ["doc_id"]))]
    assert runs[0] == runs[1] == runs[2]


def test_one_id_with_many_texts_fills_no_bucket(spark, monkeypatch):
    """Rows of one id, and of none, are spread over the buckets of their source by their texts."""
    from moleweave.llm import mixing

    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    monkeypatch.setattr(mixing, "INNER", tuple(c for c in mixing.INNER if c != "bucket"))
    docs = spark.createDataFrame([(k % 2 or None, f"w{k} x", "s") for k in range(1000)], "doc_id long, text string, source string")
    sizes = [r[1] for r in mixing.sampled(docs, 0, mixing.WEIGHTS, mixing.MOST).groupBy("bucket").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 120
