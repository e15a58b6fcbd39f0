import hashlib
import random
import re

from moleweave.llm.decontamination import decontaminate, decontamination_stage

DOCS, ITEMS = "doc_id long, text string, h long, words string", "item_id long, text string, size int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for i, text, *_ in docs:
        w, hit, ids = words(text), set(), set()
        for item, t, *_ in items:
            v = words(t)
            n = min(10, len(v))
            for k in range(len(v) - n + 1) if v else ():
                for at in range(len(w) - n + 1):
                    if w[at:at + n] == v[k:k + n]:
                        hit.update(range(at, at + n))
                        ids.add(str(item))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(map(str, out))


def found(spark, docs, items):
    rows = decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    return sorted(str((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in rows)


def test_windows_against_brute_force(spark):
    rng = random.Random(6)
    some = lambda n, most=9: " ".join(rng.choice(["a", "B", "é", "x1", "the", "of", "qu", "Zz", "9"][:most]) for _ in range(n))
    items = [(1, some(30), 0), (2, some(12), 0), (3, some(4), 0), (4, "One", 0), (5, None, 0), (6, " ,. ", 0), (1, some(11), 0), (70, some(30, 2), 0), (8, some(10), 0), (8, some(10), 0)]
    docs = []
    for i in range(40):
        w = words(items[rng.choice([0, 1, 2, 7, 8])][1])
        at = rng.randint(0, max(0, len(w) - 10))
        docs.append((i, some(rng.randint(0, 30)) + ", " + "-".join(w[at:at + rng.randint(8, 14)]) + ". " + some(rng.randint(0, 30)), 0, ""))
    docs += [(None, "one a b", 0, ""), (50, None, 0, ""), (51, "", 0, ""), docs[0], (0, "another text", 0, ""), (52, some(5000), 0, "")]
    assert found(spark, docs, items) == brute(docs, items)


def test_empty_sides(spark):
    docs, items = [(1, "a b c", 0, "")], [(1, "a b c", 0)]
    assert found(spark, [], items) == []
    assert found(spark, docs, []) == brute(docs, [])
    assert found(spark, docs, [(1, None, 0)]) == brute(docs, [])


def test_stage_keeps_clean_documents(spark, tmp_path):
    passage = " ".join(f"k{i}" for i in range(12))
    spark.createDataFrame([(1, passage, 0)], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "x " + passage, 0, ""), (2, "x y z", 0, ""), (3, None, 0, ""), (None, "clean", 0, ""), (1, "other text of the same id", 0, "")], DOCS)
    kept = decontamination_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(map(str, (r.text for r in kept.collect()))) == sorted(map(str, ["x y z", None, "clean", "other text of the same id"]))


def test_large_benchmarks_are_dealt_out_by_salts(spark, monkeypatch):
    """Beyond the blocks that are broadcast the result is the same, with an item of one word that is everywhere."""
    from moleweave.llm import decontamination

    rng = random.Random(3)
    docs = [(k, " ".join(rng.choice(["the", "a", "cat", "dog", "sat", "on", "mat"]) for _ in range(rng.randint(0, 60))), "", 0) for k in range(120)]
    items = [(0, "the", 0), (1, "the cat sat on the mat", 0), (2, "dog " * 12, 0), (3, " ".join(docs[7][1].split()[:15]), 0), (4, None, 0)]
    tables = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), spark.createDataFrame([i[:2] for i in items], "item_id long, text string")
    few = sorted(map(tuple, decontaminate(*tables).collect()))
    monkeypatch.setattr(decontamination, "BLOCKS", 0)
    assert sorted(map(tuple, decontaminate(*tables).collect())) == few and sum(r[-1] for r in few) > 50
