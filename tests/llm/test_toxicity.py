import random
import zlib

from moleweave.llm import toxicity as X


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(word, exact, misspelt, usual):
    """By the distances of the word, or of its beginnings, from every term."""
    finds = []
    for t, w in exact.items():
        least = edits(word, t[:-1]) if t.endswith("$") else min(edits(word[:n], t) for n in range(len(word) + 1))
        if least == 0 or (least == 1 and t in misspelt):
            finds.append((least, -w, t))
    if not finds or (min(finds)[0] and word in usual):
        return None
    return min(finds)[0], min(finds)[2]


def test_automaton_against_distances():
    """Random terms, some of which begin others or have the end mark, and words around them."""
    rng = random.Random(5)
    for round_ in range(30):
        terms = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 6))) + rng.choice(["", "$"]) for _ in range(rng.randint(1, 8))}
        exact = {t: 1 + k / 10 for k, t in enumerate(sorted(terms))}
        misspelt = {t: 0.5 for t in terms if rng.random() < 0.6}
        words = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 8))) for _ in range(150)] + [t.strip("$") for t in terms]
        usual = frozenset(rng.sample(words, 10))
        lexicon = X.Lexicon(exact, misspelt, usual)
        for w in words:
            found, expected = lexicon.find(w), plain(w, exact, misspelt, usual)
            assert found == expected, (round_, w, exact, misspelt)


def test_windows_tell_quotation_from_abuse():
    lexicon = X.Lexicon({"idiot$": 7.0, "moron$": 7.0}, {"idiot$": 6.0})
    value = lambda t: X.features(t, lexicon)[4]
    abuse, told, quote = value("You are an idiot and a moron!"), value('The word "idiot" is an insult.'), value('They sang "what an idiot" all day.')
    assert abuse > value("He was an idiot and a moron.") > quote > told > 0
    assert value("Such an idoit") == 0 and 0 < value("Such an idi0t.") < value("Such an idiot.") and value("Such an idiott") > 0
    assert value(None) == value("") == value("  \n") == value("idiotic moronic") == 0
    assert value('An open " mark and an idiot') == value("An open mark and an idiot")


def test_held_out_rows_and_odd_rows(spark):
    """Whole words and beginnings are learned and found misspelt; the rest of the labels decides nothing."""
    rng = random.Random(9)
    clean = ["".join(rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(rng.randint(1, 3))) for _ in range(300)]
    bad = ["gruxx", "vilex", "skorb"]

    def text(toxic):
        words = rng.choices(clean, k=rng.randint(20, 120))
        for _ in range(toxic * rng.randint(3, 6)):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "ok", "ul"]))
        return " ".join(words)

    rows = [(k, text(k % 5 == 0 or k % 7 == 0), "labels", k) for k in range(700)]
    labels = [(k, int(k % 5 == 0 or k % 7 == 0)) for k in range(700)] + [(None, 1), (3, None), (4, 0), (4, 0), (6, 1), (800, 1)]
    odd = [(800, None, "", 1), (801, "", "", 2), (None, "skorb skorb skorb " * 5, "", 3), (802, "skrb grux vilx " * 3 + " ".join(clean[:40]), "", 4), (0, rows[0][1], "x", 0), (803, "x" * 200_000 + " \x00 $$$ " + "skorb " * 50_000, "", 5)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, toxic string, score long")
    table = lambda r: spark.createDataFrame(r, "doc_id long, toxic int")
    model = X.fit(docs, table(labels))
    out = X.scored(docs, model).collect()
    assert len(out) == len(rows) + len(odd)
    truth = {k: int(k % 5 == 0 or k % 7 == 0) for k in range(700)}
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    tested = [r for r in out if r.doc_id in truth and r.held_out]
    assert len(tested) > 100 and sum(r.predicted == truth[r.doc_id] for r in tested) >= 0.97 * len(tested)
    score = {r.doc_id: r.score for r in out}
    assert score[None] > 0.5 and score[802] > 0.5 > score[801] and score[800] == score[801] and score[803] > 0.5
    # Labels of held-out rows change nothing.
    turned = [(k, 1 - y if k is not None and y is not None and zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, y in labels]
    again = X.fit(docs, table(turned))
    assert again.lexicon == model.lexicon and abs(again.weights - model.weights).max() < 1e-9
    assert X.scored(docs.where("false"), model).count() == 0
    assert {r.predicted for r in X.scored(docs, X.fit(docs, table([]))).collect()} == {0}


def test_given_rows(spark):
    """Held-out accuracy on the given tables."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = X.scored(docs, X.fit(docs, labels)).where("held_out").join(labels, "doc_id")
    n, right, caught, toxic = out.selectExpr("count(*)", "sum(int(predicted = toxic))", "sum(predicted * toxic)", "sum(toxic)").first()
    assert n > 500 and right >= 0.97 * n and caught >= 0.88 * toxic
