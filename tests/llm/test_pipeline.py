"""The stages together, against plain versions that share no code with them."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken

import corpus_pipeline
from moleweave.llm import packing

DIR = "/root/testdata/sf0.001"


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def plain_quality(docs):
    """Documents with enough words and few repeated windows, without the lines that over ten texts of their source have."""
    key = lambda line: " ".join(split(line)).lower()
    seen = defaultdict(set)
    texts = defaultdict(set)
    for d in docs:
        texts[d["source"]].add(d["text"])
        for line in (d["text"] or "").split("\n"):
            if split(line):
                seen[d["source"], key(line)].add(d["text"])
    out = []
    for d in docs:
        words = split(d["text"])
        windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        repeated = {p for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for p in range(i, i + 8)}
        if len(words) < 20 or 100 * len(repeated) > 30 * len(words):
            continue
        bad = lambda line: bool(split(line)) and len(seen[d["source"], key(line)]) > 10 and len(seen[d["source"], key(line)]) > 0.001 * len(texts[d["source"]])  # noqa: B023, E731
        lines = d["text"].split("\n")
        left = [line for line in lines if not bad(line)]
        n = sum(len(split(line)) for line in left)
        if n >= 20 and n >= 0.5 * len(words):
            out.append(d | {"text": "\n".join(left)})
    return out


def plain_near(docs):
    """Of documents linked by four fifths of their runs of five words, directly or over others, the one with the least id."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for d in docs:
        w = split(lower(d["text"]))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for d, g in zip(docs, group, strict=True):
        least[g] = min(least.get(g, d["doc_id"]), d["doc_id"])
    return [d for d, g in zip(docs, group, strict=True) if d["doc_id"] == least[g]]


def plain_clean(docs, items):
    """Documents without a run of ten words of an item, or all of a shorter one."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {tuple(w[i:i + 10]) for t in items if (w := words(t)) for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    return [d for d in docs if not any(tuple(w[i:i + n]) in windows for w in [words(d["text"])] for n in sizes for i in range(len(w) - n + 1))]


def plain_mix(docs):
    """Each document as often as whole numbers lie in its stretch of its source's sum of expected copies."""
    sizes = defaultdict(int)
    for d in docs:
        sizes[d["source"]] += len(split(d["text"]))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        stopped = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not stopped:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in stopped}
        left -= sum(3 * sizes[s] for s in stopped)
        free -= stopped
    out = []
    for s in names:
        step = min(math.floor(target[s] / sizes[s] * 2**32), 3 * 2**32) if sizes[s] else 0
        at = int(hashlib.md5(f"0|{'' if s is None else '=' + s}".encode()).hexdigest()[:8], 16)
        for d in sorted((d for d in docs if d["source"] == s), key=lambda d: (len(split(d["text"])), d["doc_id"])):
            out += [d] * (((at + step) >> 32) - (at >> 32))
            at += step
    return out


def test_each_stage_against_a_plain_version(spark):
    """Each stage, given what the one before it made, keeps the documents and texts that a plain version keeps."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    plain = [r.asDict() for r in docs.collect()]
    items = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    steps = {"quality_rules": plain_quality, "minhash_near_dedup": plain_near, "benchmark_decontamination": lambda d: plain_clean(d, items), "source_mix": plain_mix}
    sizes = [len(plain)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, columns = stage(spark, docs, DIR), docs.columns
        rows = docs.collect()
        assert docs.columns == columns
        plain = steps[name](plain)
        assert sorted((r.doc_id, r.text) for r in rows) == sorted((d["doc_id"], d["text"]) for d in plain), name
        docs = spark.createDataFrame(rows, docs.schema)
        sizes.append(len(plain))
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {packing.base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = sorted((d["doc_id"], library.encode_ordinary(d["text"])) for d in plain)
    for packed in (corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect(), corpus_pipeline.run(spark, DIR).collect()):
        whole, held = [], defaultdict(list)
        for r in packed:
            assert r.n_tokens <= packing.ROW_TOKENS
            for doc, piece, x, y in zip(r.doc_ids, r.pieces, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
                held[doc, piece].append(r.input_ids[x:y])
        copies = Counter(d["doc_id"] for d in plain)
        for doc, n in copies.items():
            pieces = []
            while (doc, len(pieces)) in held:
                assert len(held[doc, len(pieces)]) == n and all(x == held[doc, len(pieces)][0] for x in held[doc, len(pieces)])
                pieces.append(held[doc, len(pieces)][0])
            whole += [(doc, [t for x in pieces for t in x])] * n
        assert sorted(whole) == expected


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_stages_take_odd_tables(spark, tmp_path):
    """No rows; and nulls in any column, repeated rows, and columns with the names of inner ones, which are kept as they are."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, h string, words string, kept string, node string, ends string, host string"
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    same = (1, words(1, 60), "en", "a", 5, "H", "W", "K", "N", "E", "O")
    rows = [same, same, (None,) * 11, (2, None, "en", None, None, "H", "W", "K", "N", "E", "O"), (None, words(2, 60), None, "a", 1, "H", "W", "K", "N", "E", "O"), (3, "", "en", "a", 0, *"HWKNEO"), (4, words(1, 59) + " y", "en", "b", 9, *"HWKNEO"), (5, words(5, 30_000), "en", "b", 9, *"HWKNEO")]
    spark.createDataFrame([(1, "some other words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            found = out.collect()
            assert bool(found) == bool(data) and all(r.h in ("H", None) and r.kept in ("K", None) and r.node in ("N", None) and r.words in ("W", None) for r in found), name
        assert bool(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count()) == bool(data)
