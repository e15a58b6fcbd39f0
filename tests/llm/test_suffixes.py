import random

from moleweave.llm import suffixes

SCHEMA = "doc_id long, text string, h long, at string"


def brute(rows):
    """Words of each document that lie in a run of ``PASSAGE`` words that a document with another text has too; copies whole."""
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(t or "", set()).add(i)
    runs = {}
    for t in texts:
        w = t.split()
        for k in range(len(w) - suffixes.PASSAGE + 1):
            runs.setdefault(tuple(w[k:k + suffixes.PASSAGE]), set()).add(t)
    out = {}
    for t, ids in texts.items():
        w = t.split()
        hit = {p for k in range(len(w) - suffixes.PASSAGE + 1) if len(runs[tuple(w[k:k + suffixes.PASSAGE])]) > 1 for p in range(k, k + suffixes.PASSAGE)}
        if len(ids) > 1 and len(w) >= suffixes.PASSAGE:
            hit = set(range(len(w)))
        for i in ids:
            out.setdefault(i, set()).update(hit)
    return {i: h for i, h in out.items() if h}


def found(spark, rows):
    out = {}
    for r in suffixes.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.end_word - r.start_word == r.n_words >= suffixes.PASSAGE
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return out


def words(rng, n, most=10**9):
    return [f"w{rng.randint(0, most)}" for _ in range(n)]


def test_planted_passages_against_every_window(spark):
    rng = random.Random(8)
    passages = [words(rng, n) for n in (49, 50, 51, 60, 90, 200)]
    rows = []
    for i in range(60):
        parts = [words(rng, rng.randint(0, 80))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            parts += [p, words(rng, rng.randint(0, 30))]
        rows.append((i, " ".join(w for p in parts for w in p), 0, ""))
    rows += [(100, None, 0, ""), (101, "", 0, ""), (102, "short", 0, ""), (103, rows[0][1], 0, ""), rows[1], (None, " ".join(words(rng, 20) + passages[3]), 0, ""), (104, "again " * 500, 0, ""), (105, "again " * 300 + "end", 0, "")]
    expected = brute(rows)
    assert found(spark, rows) == expected


def test_common_phrases_and_texts_of_few_words(spark):
    """Passages that part after 35 to 50 words in either direction, and texts over a small vocabulary."""
    rng = random.Random(4)
    core = words(rng, 44)
    rows = [(i, " ".join(words(rng, 30, 3)[: rng.randint(0, 12)] + core + words(rng, 30, 3)), 0, "") for i in range(80)]
    rows += [(500 + i, " ".join(words(rng, 120, 2)), 0, "") for i in range(10)]
    assert found(spark, rows) == brute(rows)


def test_one_id_with_several_texts(spark):
    """Passages are of texts: a copy under an id does not hide what another text of the id shares."""
    rng = random.Random(7)
    a, shared = words(rng, 70), words(rng, 60)
    rows = [(1, " ".join(a), 0, ""), (2, " ".join(a), 0, ""), (1, " ".join(words(rng, 20) + shared), 0, ""), (3, " ".join(words(rng, 30) + shared), 0, "")]
    out = suffixes.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word, r.other_doc) for r in out) == [(1, 0, 70, 2), (1, 20, 80, 3), (2, 0, 70, 1), (3, 30, 90, 1)]


def test_partition_ends_are_compared_over_several_levels(spark, monkeypatch):
    """With many partitions, groups of few of them, and hardly more rows than partitions."""
    monkeypatch.setattr(suffixes, "GROUP", 3)
    monkeypatch.setattr(suffixes, "shuffles", lambda spark: 23)
    rng = random.Random(11)
    passages = [words(rng, n) for n in (60, 75, 90)]
    rows = [(i, " ".join(words(rng, rng.randint(0, 30)) + passages[i % 3] + words(rng, rng.randint(0, 30))), 0, "") for i in range(15)]
    assert found(spark, rows) == brute(rows)


def test_empty(spark):
    assert suffixes.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_of_other_types(spark):
    """Texts as ids: the same passages, with the ids as they came."""
    rng = random.Random(12)
    shared, copy = words(rng, 70), " ".join(words(rng, 80))
    rows = [(k, " ".join(words(rng, 20) + shared + words(rng, k)), 0, "") for k in range(6)] + [(10, copy, 0, ""), (11, copy, 0, ""), (12, "short", 0, ""), (None, copy, 0, "")]
    named = spark.createDataFrame([(i if i is None else f"doc-{i}", t) for i, t, *_ in rows], "doc_id string, text string")
    got = {}
    for r in suffixes.repeated_passages(named).collect():
        assert r.other_doc is None or r.other_doc.startswith("doc-")
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert got == {i if i is None else f"doc-{i}": h for i, h in brute(rows).items()} and len(got) == 9
