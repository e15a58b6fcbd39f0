import random

import public_tokenizers
from tokenizers import Tokenizer

from moleweave.llm.token_counts import token_counts

SCHEMA = "doc_id long, text string, n long, chunk string"


def test_counts_against_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(3)
    pieces = ["Hello", "don't", "<|endoftext|>", "x<|startoftext|>y", "Ünïcödé", "日本語", " ", "　", "123abc", "...!!", "\n", "\t", "😀👍🏽", "é", "'s", "İ", "ﬁ", "\x00", "\x85", " ", "a​b", "_", "don'T"]
    rows = [(i, "".join(rng.choice([*pieces, " ", " ", "  "]) for _ in range(rng.randint(0, 60))), 0, "") for i in range(200)]
    rows += [(900, None, 0, ""), (901, "", 0, ""), (902, "word " * 30_000, 0, ""), (903, "é" * 3000, 0, ""), (None, "null id", 0, ""), rows[0], rows[0], (0, "other text", 0, "")]
    expected = []
    for i, t, *_ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        expected.append(str((i, len((t or "").encode()), n, n > 2048)))
    found = [str((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit)) for r in token_counts(spark.createDataFrame(rows, SCHEMA), path).collect()]
    assert sorted(found) == sorted(expected)


def test_empty(spark):
    assert token_counts(spark.createDataFrame([], SCHEMA), public_tokenizers.path("word_bpe_49k.json")).count() == 0
