import random

import numpy as np
import public_tokenizers

from moleweave.llm import packing

SCHEMA = "doc_id long, text string, row_id long, n_tokens string"


def test_best_fit_against_a_plain_search():
    rng = random.Random(1)
    for most in (1, 7, 64, 100):
        sizes = [rng.randint(1, most) for _ in range(300)]
        rows, room = [], []
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            fits = [r for r in range(len(rows)) if room[r] >= sizes[k]]
            best = min(fits, key=lambda r: room[r], default=None)
            if best is None:
                rows.append([])
                room.append(most)
                best = len(rows) - 1
            rows[best].append(k)
            room[best] -= sizes[k]
        found = packing.best_fit_decreasing(sizes, most)
        # Which of several rows with equal room is filled is free, how full the rows become is not.
        assert sorted(sum(sizes[k] for k in r) for r in found) == sorted(sum(sizes[k] for k in r) for r in rows)
        assert sorted(k for r in found for k in r) == list(range(300))


def test_documents_come_back_whole(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "é", "x"]) for _ in range(rng.randint(0, 60))), 0, "") for i in range(80)]
    rows += [(500, "long " * 3000, 0, ""), (501, None, 0, ""), (502, "", 0, ""), (None, "no id", 0, "")]
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    width = 64
    packed = packing.pack(docs, path, pattern, width=width, pad=7, block=500).collect()
    parts = {}
    for r in packed:
        assert len(r.input_ids) == len(r.position_ids) == width and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= width
        assert r.input_ids[r.n_tokens:] == [7] * (width - r.n_tokens)
        for doc, piece, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert r.position_ids[a:b] == list(range(b - a))
            parts.setdefault(doc, {})[piece] = r.input_ids[a:b]
    encode = packing.load_ranks(path, pattern)
    whole = {d: [t for k in sorted(p) for t in p[k]] for d, p in parts.items()}
    assert whole == {i: encode.encode_ordinary(t) for i, t, *_ in rows if t}
    assert encode.decode(whole[500]) == "long " * 3000
    assert len({r.row_id for r in packed}) == len(packed)


def test_long_runs_are_encoded_like_the_library_does(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encode, library = packing.encoder(path, pattern), packing.load_ranks(path, pattern).encode_ordinary
    rng = random.Random(5)
    for run in ("\n", " ", "\t", "\u3000", "\r\n", " \n", "\u2028"):
        for before in ("", "a", "it's ", "9"):
            for after in ("", "b", " 'll go", "\u00e9", "!?"):
                for n in (packing.LONG_SPACE, packing.LONG_SPACE + rng.randint(1, 9)):
                    text = before + run * n + after + run * 3 + after
                    assert encode(text) == library(text)
    text = "\x1c" * 30_000 + "x" + "\x85" * 30_000 + "y"
    assert encode(text) == library(text)


def test_millions_of_one_character(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encode, decode = packing.encoder(path, pattern), packing.load_ranks(path, pattern).decode
    for x in ("\n", " ", "a", "1", "!", "\u00e9", "\t", "\u4e00"):
        assert decode(encode(x * 5_000_000 + "end")) == x * 5_000_000 + "end"
    rows = [(1, "\n" * 2_000_000, 0, ""), (2, " " * 2_000_000 + "x", 0, "")]
    packed = packing.pack(spark.createDataFrame(rows, SCHEMA), path, pattern).select("doc_ids", "n_tokens").collect()
    assert sum(r.n_tokens for r in packed) == sum(len(encode(t)) for _, t, *_ in rows)


def test_files_hold_the_rows_and_only_those_of_the_manifest(spark, tmp_path):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = [(i, "word " * (i % 37), 0, "") for i in range(300)]
    root = f"file://{tmp_path}/packed"
    manifest = packing.write_packed(spark.createDataFrame(rows, SCHEMA).repartition(2), root, path, pattern, width=20, pad=9, block=200, roll=16)
    files = manifest.collect()
    assert len(files) > 4
    (tmp_path / "packed" / "000000-999-00000.ids").write_bytes(b"left by a lost task")
    found = {r.row_id: r for r in packing.read_packed(manifest, root).collect()}
    assert len(found) == sum(f.n_rows for f in files)
    for f in files:
        ids = np.fromfile(f"{tmp_path}/packed/{f.path}.ids", f"<u{f.id_bytes}").reshape(f.n_rows, f.width)
        resets = np.unpackbits(np.fromfile(f"{tmp_path}/packed/{f.path}.resets", np.uint8).reshape(f.n_rows, -1), axis=1, count=f.width)
        ends = np.fromfile(f"{tmp_path}/packed/{f.path}.cu", "<i4")
        assert resets.sum() == f.n_segments and len(ends) == f.n_segments + f.n_rows and (ends == 0).sum() == f.n_rows
        for k in range(f.n_rows):
            r = found[f.first_row + k]
            assert r.input_ids == ids[k].tolist() and r.cu_seqlens[:-1] == np.flatnonzero(resets[k]).tolist()
            assert [i for i, p in enumerate(r.position_ids[: r.n_tokens]) if p == 0] == r.cu_seqlens[:-1]


def test_repeated_rows_and_empty(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    twice = packing.pack(spark.createDataFrame([(1, "same", 0, ""), (1, "same", 0, "")], SCHEMA).coalesce(1), path, pattern, width=16).collect()
    assert len(twice) == 1 and twice[0].doc_ids == [1, 1]
    assert packing.pack(spark.createDataFrame([], SCHEMA), path, pattern).count() == 0
