"""Token counts without token ids.

A first pass splits each text into pre-tokens with the library's own rules and counts each distinct one of the document.
Spark makes the pre-tokens of all documents distinct, their pieces are counted once each, and the counts are joined to
the documents' frequencies and summed. Frequent pre-tokens are joined by a broadcast of bounded bytes and rare ones by a
shuffle, so no task gets a hot key.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moleweave.llm.common import BROADCAST_BYTES, SPACES, keep, table

#: Stands before a special string's text, which is one piece; no other pre-token has white space in it.
SPECIAL = " "
#: Frequencies of so many documents' pre-tokens are sent on at once.
OUT_ROWS = 1 << 16
#: Chunks whose pre-tokens a worker remembers.
KNOWN = 200_000


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_strings(path: str) -> list[str]:
    """The special tokens that the library finds in raw text before anything else, longest first."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    splits = json.dumps(spec.get("pre_tokenizer") or {})
    if "\\\\s\\\\p{L}" not in splits or '"Removed"' not in splits:
        raise ValueError("only tokenizers whose pre-tokenizer drops white space are counted by chunk")
    found = [t["content"] for t in spec["added_tokens"]]
    if any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that depend on their neighbours are not supported")
    return sorted(found, key=len, reverse=True)


def frequent_from(counts: DataFrame, key: str, n: str, most: int = BROADCAST_BYTES) -> int | None:
    """The least frequency such that the keys as frequent take at most ``most`` bytes, from the keys of each frequency."""
    running = F.sum("bytes").over(Window.orderBy(F.desc(n)))
    steps = counts.groupBy(n).agg(F.sum(F.octet_length(key) + 48).alias("bytes")).withColumn("running", running)
    return steps.where(F.col("running") <= most).agg(F.min(n)).first()[0]


def frequent_join(big: DataFrame, small: DataFrame, key: str, n: str, most: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Join ``big`` to ``small`` on ``key``; ``small`` has each key once with its frequency ``n`` in ``big``.

    Returns the rows whose keys are the most frequent that fit into ``most`` bytes, joined by broadcast, and the rest,
    joined by shuffle, of which no key is more frequent than those.
    """
    least = frequent_from(small, key, n, most)
    often = F.col(n) >= least if least is not None else F.lit(False)
    top = F.broadcast(small.where(often).drop(n))
    return big.join(top, key), big.join(F.broadcast(small.where(often).select(key)), key, "left_anti").join(small.where(~often).drop(n), key)


class Splits(dict):
    """Chunk to its pre-tokens, found when first asked for. It is emptied when it holds ``KNOWN`` chunks.

    Chunks of printable ASCII are split by the tokenizer's own pattern, others by the library: on those the pattern's
    classes and lower case are the same in every version of Unicode, and bytes stand for themselves.
    """

    def __init__(self, path: str) -> None:
        self.tok, special = load_tokenizer(path), special_strings(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in steps]
        simple = kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and steps[0]["invert"]
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"]) if simple else None
        self.cutter = re.compile("(" + "|".join(map(re.escape, special)) + ")" if special else r"(?!)")
        self.printable = re.compile(r"[!-~]+")

    def __missing__(self, chunk: str) -> tuple[str, ...]:
        out: list[str] = []
        for k, part in enumerate(self.cutter.split(chunk)):
            if k % 2:
                out.append(SPECIAL + part)
            elif part and self.pattern and self.printable.fullmatch(part):
                out += [part.lower()] if part.isalpha() else self.pattern.findall(part.lower())
            elif part:
                out += [x for x, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part))]
        if len(self) >= KNOWN:
            self.clear()
        found = self[chunk] = tuple(out)
        return found


def document_pretokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, h, text) -> doc_id, h, found: how often each pre-token is in the text, a map.

    The tokenizer drops white space, so texts are split at it first; what a chunk splits into is remembered.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splits(path).__getitem__
        # Python's white space is the tokenizer's, but for four control characters.
        odd, spaces = re.compile("[\x1c-\x1f]"), re.compile(f"[{SPACES}]+")

        def maps(rows: list[int], ends: list[int], tokens: list[str], counts: list[int], batch: pa.RecordBatch) -> pa.RecordBatch:
            at = pa.array(rows, pa.int64())
            found = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens, pa.string()), pa.array(counts, pa.int32()))
            return pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("h").take(at), found], ["doc_id", "h", "found"])

        for batch in batches:
            rows, ends, tokens, counts = [], [0], [], []
            for i, value in enumerate(batch.column("text")):
                text = value.as_py() or ""
                found = Counter(chain.from_iterable(map(split, spaces.split(text) if odd.search(text) else text.split())))
                tokens += found
                counts += found.values()
                rows.append(i)
                ends.append(len(tokens))
                if len(tokens) >= OUT_ROWS:
                    yield maps(rows, ends, tokens, counts, batch)
                    rows, ends, tokens, counts = [], [0], [], []
            yield maps(rows, ends, tokens, counts, batch)

    return docs.mapInArrow(run, f"doc_id {kind}, h long, found map<string,int>")


def token_pieces(tokens: DataFrame, path: str) -> DataFrame:
    """(token, uses) -> (token, uses, pieces): the pieces of each distinct pre-token."""

    @F.pandas_udf("long")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_tokenizer(path).model
        for batch in batches:
            yield batch.map(lambda x: 1 if x.startswith(SPECIAL) else len(model.tokenize(x)))

    return tokens.withColumn("pieces", pieces("token"))


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Token count of every whole text, one row per input row.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and repeated ids with other texts each get a row of
    their own; a null id is kept. Other columns of ``docs`` are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = base.select("doc_id", F.xxhash64("text").alias("h"), "text")
    used = keep(document_pretokens(base, tokenizer), "pretokens", "zstd").select("doc_id", "h", F.explode("found").alias("token", "n"))
    pieces = keep(token_pieces(used.groupBy("token").agg(F.count("*").alias("uses")), tokenizer), "pieces")
    head, tail = frequent_join(used, pieces, "token", "uses")
    part = lambda x: x.groupBy("doc_id", "h").agg(F.sum(F.col("n") * F.col("pieces")).alias("part"))
    rows = base.groupBy("doc_id", "h", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")).agg(F.count("*").alias("copies"))
    sums = part(head).unionByName(part(tail))
    return (
        rows.withColumn("part", F.lit(0).cast("long"))
        .unionByName(sums.select("doc_id", "h", F.lit(None).cast("long").alias("n_bytes"), F.lit(None).cast("long").alias("copies"), "part"))
        .groupBy("doc_id", "h")
        .agg(F.max("n_bytes").alias("n_bytes"), F.max("copies").alias("copies"), F.sum("part").alias("total"))
        .withColumn("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
        .select("doc_id", "n_bytes", (F.col("total") / F.col("copies")).cast("long").alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLES: dict[str, str] = {}
