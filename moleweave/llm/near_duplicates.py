"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 32-bit numbers give all coordinates: a shingle's place under the first one is shifted by the
coordinate's number, around the end, and looked up in the second; a document's coordinate is the least over its
shingles. Documents with equal sets are one class and are signed, linked and counted as one. Classes that share a band
are candidates. Each class is first checked against the class with which it shares most bands as a bucket's first
member, then, where a bucket still holds several components, against a few more heads of it, and what that leaves is
joined across components by the rarest shingles of the sets; what meets a large component that way is joined by the
rarest of the differences from that component's head. Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moleweave.llm.common import ascii_lower, bind, cut, keep, lookup, once, table, word_array

#: A pair of similarity 0.8 shares none of 40 bands of 6 coordinates with probability 5e-6.
BANDS, ROWS = 40, 6
#: Shingles are counted by so many places.
SKETCH = 1 << 18
#: Heads that a bucket gets after its first one.
ROUNDS = 4
#: Pairs or labels, of two 16-byte names each, that are broadcast; more of them are joined by shuffles.
SMALL = 20_000
#: A component of more members is compared with others by differences from its head.
CROWD = 16
#: Longs of a set's bitmap.
LONGS = 16
#: Shingles signed at once, so that the work stays in the processor's cache.
CHUNK = 1 << 15


def shingle_set(text: Column, size: int) -> Column:
    """Distinct 64-bit hashes of the runs of ``size`` words; of the whole sequence if it is shorter; none without words."""
    def of(words: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size)))
        return F.when(F.size(words) >= size, F.array_distinct(runs)).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))

    return bind(word_array(ascii_lower(F.coalesce(text, F.lit("")))), of)


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute32(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash of the sets values[starts[i]:starts[i + 1]], none of them empty: a row for each, ``size`` wide."""
    place = (mix64(values, 1) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((size, len(starts) - 1), np.uint32)
    i = 0
    while i < len(starts) - 1:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + CHUNK, "right")) - 1)
        part, at = place[starts[i]:starts[j]], starts[i:j] - starts[i]
        for k in range(size):
            out[k, i:j] = np.minimum.reduceat(permute32(part + np.uint32(k)), at)
        i = j
    return out.T


def sign(bands: int, rows: int):
    """Arrow batches of doc_id, h, set -> doc_id, h, n, node, buckets.

    node is a 128-bit hash of the set, null if empty; buckets are 64-bit hashes of a band's number and its coordinates.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("set")
            counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            full = np.flatnonzero(counts)
            starts = np.concatenate([[0], np.cumsum(counts[full])]).astype(np.int64)
            node, band = np.full(len(counts), None, object), np.full(len(counts), None, object)
            if len(full):
                signs = signatures(values, starts, bands * rows).astype(np.uint64).reshape(len(full), bands, rows)
                keys = np.tile(mix64(np.arange(bands, dtype=np.uint64), 5), (len(full), 1))
                for r in range(rows):
                    keys = mix64(keys ^ signs[:, :, r], r + 2)
                sums = np.stack([np.add.reduceat(mix64(values, s), starts[:-1]) for s in (11, 13)], 1).astype(">u8")
                for i, k in enumerate(full):
                    node[k], band[k] = sums[i].tobytes(), keys[i].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(counts, pa.int64()), pa.array(node, pa.binary()), pa.array(band, pa.list_(pa.int64()))], ["doc_id", "h", "n", "node", "buckets"]
            )

    return run


def settled(df: DataFrame) -> DataFrame:
    """A narrow table that later rounds build on, written and read: unlike checkpoints, files carry no conditions on their
    columns along, which would multiply from round to round and take the planner minutes."""
    return keep(df, "near")


def held(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """``df``, to be broadcast to its joins if it is counted to have at most ``limit`` narrow rows; it should be cut."""
    return F.broadcast(df) if df.count() <= limit else df


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, comp): each node of a link with the least node that it reaches.

    Labels travel along links and then along themselves, so paths halve; ends when no label changes. A round has one
    shuffle where the labels are few enough to be broadcast.
    """
    pair = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    both = settled(links.select(F.explode(F.array(pair("a", "b"), pair("b", "a"), pair("a", "a"), pair("b", "b"))).alias("e")).select("e.*"))
    labels = settled(both.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("node"), "comp"))
    few = labels.count() <= SMALL
    while True:
        labels = F.broadcast(labels) if few else labels
        own = F.max(F.when(F.col("a") == F.col("b"), F.col("comp"))).alias("was")
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(own, F.min("comp").alias("near"))
        jump = labels.select(F.col("node").alias("j"), F.col("comp").alias("to"))
        new = settled(near.join(jump, F.col("near") == F.col("j")).select(F.col("a").alias("node"), "was", F.least("near", "to").alias("comp")))
        labels = new.select("node", "comp")
        if new.where("was <> comp").isEmpty():
            return F.broadcast(labels) if few else labels


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    Each pair goes to the text of its one end and then, with that text, to the text of the other. Pairs that are few
    enough are broadcast for the first step, so that only texts that are asked for move, and once.
    """
    pairs = held(pairs)
    right = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    left = texts.join(held(settled(pairs.select(F.col("a").alias("node")).distinct())), "node", "left_semi").select(F.col("node").alias("a"), F.col("text").alias("ta"))
    joined = right.join(left, "a")
    sets = F.struct(shingle_set(F.col("ta"), size).alias("x"), shingle_set(F.col("tb"), size).alias("y"))
    sizes = lambda s: F.struct(F.size(F.array_intersect(s["x"], s["y"])).alias("i"), (F.size(s["x"]) + F.size(s["y"])).alias("s"))
    return settled(once(joined, sets, sizes).where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b"))


def frequencies(used: DataFrame) -> np.ndarray:
    """How many rows (shingle) fall on each of SKETCH places: enough to tell rare from frequent ones."""
    rows = used.groupBy(F.pmod("shingle", F.lit(SKETCH)).alias("place")).agg(F.count("*").alias("n")).toPandas()
    out = np.zeros(SKETCH, np.int64)
    out[rows["place"].to_numpy(np.int64)] = rows["n"]
    return out


def outlines(nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, n, prefix, bits_0, ...) of the nodes (node, n).

    prefix has the rarest shingles, in an order that all nodes share, of which two
    sets of the similarity have one in common. bits tell for each place of a bitmap whether an odd number of the node's
    shingles falls on it: two bitmaps differ in no more places than their sets differ in shingles.
    """
    counts = frequencies(texts.join(nodes.select("node"), "node", "left_semi").select(F.explode(shingle_set(F.col("text"), size)).alias("shingle")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("set")
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            owner, own = np.repeat(np.arange(len(lists)), np.diff(ends)), values[ends[0]:ends[-1]]
            place = (mix64(own.view(np.uint64), 31) % np.uint64(64 * LONGS)).astype(np.int64)
            odd = np.zeros((len(lists), 64 * LONGS), np.uint8)
            np.bitwise_xor.at(odd, (owner, place), 1)
            words = np.packbits(odd, axis=1).view(np.int64)
            often = counts[own % SKETCH]
            ordered = own[np.lexsort((own, often, owner))]
            starts, n = ends[:-1] - ends[0], np.diff(ends)
            most = n + (-percent * n) // 100 + 1
            prefix = [ordered[a:a + k] for a, k in zip(starts, most)]
            columns = [batch.column("node"), batch.column("n"), pa.array(prefix, pa.list_(pa.int64())), *(pa.array(words[:, k]) for k in range(LONGS))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "prefix", *(f"bits_{k}" for k in range(LONGS))])

    sets = texts.join(nodes, "node").select("node", "n", shingle_set(F.col("text"), size).alias("set"))
    return settled(sets.mapInArrow(run, "node binary, n long, prefix array<long>, " + ", ".join(f"bits_{k} long" for k in range(LONGS))))


def fits(percent: int, least_a: Column, most_a: Column, left_a: Column, least_b: Column, most_b: Column, left_b: Column) -> Column:
    """Whether a set within the one bounds may have the similarity with a set within the others that is no smaller."""
    enough = percent * (least_a + F.greatest(least_a, least_b))
    return (least_a <= most_b) & (100 * most_a >= percent * least_b) & ((100 + percent) * F.least(left_a, left_b) >= enough)


def meetings(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (node, n, comp, prefix): the shingles of several components, and where two components may have a pair.

    The prefix of the larger set meets the first part of that of the smaller, which is shorter the nearer the sizes have to
    be; where they meet, what is left of both has to be enough. Shingles within one component are left out, and those of
    several go from component to component, and only where the bounds of both allow a pair, so no pairs are made within a
    component, however large it is.
    """
    first = F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)) + 1
    at = rows.select("node", "n", "comp", F.posexplode("prefix").alias("pos", "token"))
    at = at.select("node", "n", "comp", "token", (F.col("n") - F.col("pos")).alias("left"), (F.col("pos") < first).alias("first"))
    several = at.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bool_or("first").alias("first"))
    at = settled(at.join(several.where("lo <> hi and first").select("token"), "token", "left_semi"))

    def ends(df: DataFrame, s: str) -> DataFrame:
        """Of each shingle and component, the least and largest set and the most that is left of one."""
        return df.groupBy("token", F.col("comp").alias(f"comp_{s}")).agg(F.min("n").alias(f"least_{s}"), F.max("n").alias(f"most_{s}"), F.max("left").alias(f"left_{s}"))

    c = F.col
    ways = ends(at.where("first"), "a").join(ends(at, "b"), "token").where((c("comp_a") != c("comp_b")) & fits(percent, c("least_a"), c("most_a"), c("left_a"), c("least_b"), c("most_b"), c("left_b")))
    return at, ways.select("token", "comp_a", "comp_b", "least_b", "most_b", c("left_b").alias("room_b"))


def expanded(at: DataFrame, ways: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of members of the components that ways lead between which may have the similarity."""
    c = F.col
    side = lambda df, s: df.select("token", *[F.col(x).alias(f"{x}_{s}") for x in ("node", "n", "comp", "left")])
    found = side(at.where("first"), "a").join(ways, ["token", "comp_a"]).where(fits(percent, c("n_a"), c("n_a"), c("left_a"), c("least_b"), c("most_b"), c("room_b")))
    found = found.join(side(at, "b"), ["token", "comp_b"]).where((F.struct("n_a", "node_a") < F.struct("n_b", "node_b")) & fits(percent, c("n_a"), c("n_a"), c("left_a"), c("n_b"), c("n_b"), c("left_b")))
    return found.select(c("node_a").alias("a"), c("node_b").alias("b")).distinct()


def prefix_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of rows (node, n, comp, prefix) of different components that may have the similarity."""
    return expanded(*meetings(rows, percent), percent)


def crowded(rows: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, comp) where a way leads between a component and one of more than CROWD members, and the ways between the rest.

    The larger component is the host. Ways between two that have the same largest host are left out as well: members of
    both are compared by their differences from its head.
    """
    c = F.col
    many = held(settled(rows.groupBy("comp").agg(F.count("*").alias("m")).where(c("m") > CROWD)))
    one, two = (many.select(c("comp").alias(f"comp_{x}"), F.struct("m", "comp").alias(f"size_{x}")) for x in "ab")
    met = settled(ways.select("comp_a", "comp_b").distinct().join(one, "comp_a", "left").join(two, "comp_b", "left").where("size_a is not null or size_b is not null"))
    larger = c("size_b").isNull() | (c("size_a") > c("size_b"))
    guests = met.select(F.when(larger, c("size_a")).otherwise(c("size_b")).alias("size"), F.when(larger, c("comp_b")).otherwise(c("comp_a")).alias("comp")).distinct()
    guests = settled(guests)
    roots = guests.join(many.select("comp"), "comp", "left_anti").groupBy("comp").agg(F.max("size.comp").alias("root"))
    roots = held(settled(roots.unionAll(many.select("comp", F.lit(None).cast(rows.schema["comp"].dataType)))))
    for x in "ab":
        ways = ways.join(roots.select(c("comp").alias(f"comp_{x}"), c("root").alias(f"root_{x}"), F.lit(True).alias(f"rooted_{x}")), f"comp_{x}", "left")
    host = lambda x: c(f"rooted_{x}").isNotNull() & c(f"root_{x}").isNull()
    apart = ~host("a") & ~host("b") & ~F.coalesce(c("root_a") == c("root_b"), F.lit(False))
    return guests.select(c("size.comp").alias("host"), "comp"), ways.where(apart).drop("root_a", "root_b", "rooted_a", "rooted_b")


def differences(rows: DataFrame, guests: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(host, head, n_head, node, n, guest, away) of the members of hosts and of the components (host, comp) that meet them.

    head is the smallest member of the host; away has the shingles of one of the sets of node and head alone, the rarest first.
    """
    own = guests.select("host", F.col("host").alias("comp")).distinct()
    asked = held(settled(guests.withColumn("guest", F.lit(True)).unionAll(own.withColumn("guest", F.lit(False)))))
    asked = settled(rows.join(asked, "comp").select("host", "node", "n", "guest"))
    heads = asked.where("not guest").groupBy("host").agg(F.min(F.struct("n", "node")).alias("least")).select("host", F.col("least.node").alias("head"), F.col("least.n").alias("n_head"))
    heads = heads.join(texts.withColumnRenamed("node", "head"), "head").select("host", "head", "n_head", shingle_set(F.col("text"), size).alias("own"))
    both = lookup(texts.join(asked, "node"), settled(heads), ["host"], "inner")
    sets = F.struct(shingle_set(F.col("text"), size).alias("x"), F.col("own").alias("y"))
    apart = once(both, sets, lambda s: F.struct(F.concat(F.array_except(s["x"], s["y"]), F.array_except(s["y"], s["x"])).alias("away")))
    apart = keep(apart.select("host", "head", "n_head", "node", "n", "guest", "away"), "away")
    counts = frequencies(apart.select(F.explode("away").alias("shingle")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("away")
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            owner, own = np.repeat(np.arange(len(lists)), np.diff(ends)), values[ends[0]:ends[-1]]
            ordered = pa.array(own[np.lexsort((own, counts[own % SKETCH], owner))], pa.int64())
            away = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), ordered)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(6)), away], batch.schema.names)

    return keep(apart.mapInArrow(run, apart.schema), "away")


def near_heads(apart: DataFrame, percent: int) -> DataFrame:
    """(a, b): the heads and the guests that have the similarity with them, as all their differences tell."""
    near = F.col("guest") & ((100 + percent) * F.size("away") <= (100 - percent) * (F.col("n") + F.col("n_head")))
    return apart.where(near).select(F.col("head").alias("a"), F.col("node").alias("b"))


def head_pairs(apart: DataFrame, labels: DataFrame, percent: int, leading: bool = False) -> DataFrame:
    """(a, b): the pairs of guests, and of guests and members, of different components that may have the similarity.

    ``labels`` has (node, comp) with the links of :func:`near_heads`. A guest a that is still apart is not similar to the
    head. Its differences from a similar set b are those from the head that the two do not share, so they share some; where
    the rarest of these meet, what is left of both has to be enough. Of b's only about the rarer half come in question.
    ``leading`` asks for each shingle only the one of the host's component that differs least from the head.
    """
    c = F.col
    label = lambda x, y: labels.select(c("node").alias(x), c("comp").alias(y))
    now = apart.join(label("node", "comp"), "node", "left").join(label("head", "home"), "head", "left")
    now = now.withColumns({"comp": F.coalesce("comp", "node"), "home": F.coalesce("home", "head"), "d": F.size("away")})
    side = lambda df, s: df.select("host", "n_head", "home", *[c(x).alias(f"{x}_{s}") for x in ("node", "n", "comp", "d")], F.posexplode("away").alias(f"pos_{s}", "token"))
    a = side(now.where(c("guest") & (c("comp") != c("home"))), "a").where(percent * (2 * c("pos_a") - c("d_a") + 1) <= (100 - percent) * c("n_a"))
    a = settled(a.drop("n_head", "home"))
    b = side(now, "b").where((100 + percent) * (2 * c("pos_b") - c("d_b")) < (100 - percent) * (c("n_b") - c("n_head")))
    b = b.join(a.select("host", "token").distinct(), ["host", "token"], "left_semi")
    if leading:
        least = F.min(F.struct("d_b", "n_b", "node_b", "comp_b", "pos_b")).alias("least")
        b = b.where(c("comp_b") == c("home")).groupBy("host", "token").agg(least).select("host", "token", "least.*")
    shared = F.least(c("d_a") - c("pos_a"), c("d_b") - c("pos_b"))
    enough = (100 + percent) * (c("d_a") + c("d_b") - 2 * shared) <= (100 - percent) * (c("n_a") + c("n_b"))
    pairs = a.join(b, ["host", "token"]).where((c("comp_a") != c("comp_b")) & enough)
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def similar_bits(percent: int) -> Column:
    """Whether the bitmaps of a and b are as near as those of sets of the similarity are. A quarter is counted first."""
    differ = lambda k: sum((F.bit_count(F.col(f"bits_{i}_a").bitwiseXOR(F.col(f"bits_{i}_b"))) for i in range(1, k)), F.bit_count(F.col("bits_0_a").bitwiseXOR(F.col("bits_0_b"))))
    few = lambda k: (100 + percent) * differ(k) <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
    return few(LONGS // 4) & few(LONGS)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text) -> doc_id, h, n_shingles, component_id, kept; one row per input row.

    Documents without words, or null, have no shingles and are linked with nothing. Repeated rows are one class and all
    get their row. A null id never becomes a component's id unless all ids of the component are null. Other columns are
    ignored; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = docs.select("doc_id", "h", shingle_set(F.col("text"), size).alias("set"))
    signed = cut(signed.mapInArrow(sign(bands, rows), f"doc_id {kind}, h long, n long, node binary, buckets array<long>"))
    classes = signed.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "h")).alias("row"), F.first("n").alias("n"), F.first("buckets").alias("buckets"), F.count("*").alias("docs")
    )
    classes = cut(classes)
    buckets = classes.select("node", "n", F.explode("buckets").alias("bucket"))
    shared = settled(buckets.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("head"), F.count("*").alias("m")).where("m > 1").drop("m"))
    members = settled(lookup(buckets, shared, ["bucket"], "inner", limit=0, salts=2).select("bucket", "node", "n", "head"))
    alike = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    stars = members.where((F.col("node") != F.col("head.node")) & alike(F.col("n"), F.col("head.n")))
    stars = stars.groupBy(F.col("head.node").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("bands"))

    asked = members.select("node").distinct().join(classes.select("node", "row.doc_id", "row.h"), "node")
    texts = lookup(docs, asked.groupBy("doc_id", "h").agg(F.first("node").alias("node")), ["doc_id", "h"], "inner", salts=1)
    texts = keep(texts.select("node", "text").dropDuplicates(["node"]), "texts")

    tried = settled(stars.groupBy("b").agg(F.max_by("a", F.struct("bands", "a")).alias("a")).select("a", "b"))
    found = components(verified(tried, texts, size, percent))

    def joined(more: DataFrame) -> DataFrame:
        """The labels after more links: only the components that these link are gone through again."""
        one, two = (found.select(F.col("node").alias(x), F.col("comp").alias(c)) for x, c in (("a", "ca"), ("b", "cb")))
        ends = more.join(one, "a", "left").join(two, "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
        ends = settled(ends)
        onward = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("ca"), F.col("comp").alias("to"))
        label = lambda x, c: F.struct(F.col(x).alias("node"), F.col(c).alias("comp"))
        every = found.unionAll(ends.select(F.explode(F.array(label("a", "ca"), label("b", "cb"))).alias("e")).select("e.*")).distinct()
        return held(settled(every.join(onward, F.col("comp") == F.col("ca"), "left").select("node", F.coalesce("to", "comp").alias("comp"))))

    def divided(rows: DataFrame) -> DataFrame:
        """(bucket, comp, n, node): the smallest member of each component of the buckets that hold several; it has the least of its own."""
        now = rows.drop("comp").join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = now.groupBy("bucket", "comp").agg(F.min(F.struct("n", "node")).alias("least")).select("bucket", "comp", "least.n", "least.node")
        several = least.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
        return least.join(several, "bucket", "left_semi")

    mixed = settled(divided(members.select("bucket", "node", "n")))
    open_nodes = asked.select("node").join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(mixed.select("comp").distinct(), "comp", "left_semi")
    bits = outlines(open_nodes.select("node").join(classes.select("node", "n"), "node"), texts, size, percent)
    bits, prefixes = bits.drop("prefix"), bits.select("node", "n", "prefix")

    def plausible(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sizes and bitmaps allow the similarity."""
        for x in ("a", "b"):
            pairs = pairs.join(bits.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in bits.columns if c != "node"]), x)
        return pairs.where(alike(F.col("n_a"), F.col("n_b")) & similar_bits(percent)).select("a", "b")

    # The member with the least of its own is nearest to what the others have in common, so most of them link to it. Each
    # round has as head a component that has had none in the bucket; a round that links nothing ends them early.
    used: DataFrame | None = None
    for _ in range(ROUNDS):
        open_ = mixed
        if used is not None:
            led = used.join(found, F.col("head") == F.col("node"), "left").select("bucket", F.coalesce("comp", "head").alias("comp")).distinct()
            open_ = mixed.join(led, ["bucket", "comp"], "left_anti")
        best = F.min(F.struct("n", F.col("node").alias("head"), F.col("comp").alias("head_comp"))).alias("best")
        heads = settled(open_.groupBy("bucket").agg(best).select("bucket", "best.head", "best.head_comp"))
        near = mixed.join(heads, "bucket").where(F.col("comp") != F.col("head_comp")).select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
        near = settled(plausible(near.join(tried, ["a", "b"], "left_anti")))
        if near.isEmpty():
            break
        tried = settled(tried.unionAll(near))
        links = verified(near, texts, size, percent)
        if links.isEmpty():
            break
        found = joined(links)
        mixed = settled(divided(mixed))
        used = heads.select("bucket", "head") if used is None else settled(used.unionAll(heads.select("bucket", "head")))
    # What heads have not linked is compared across components where the rarest shingles meet, with large ones by their heads.
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    labelled = prefixes.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    labelled = keep(labelled.join(mixed.select("comp").distinct(), "comp", "left_semi"), "prefixes")
    at, ways = meetings(labelled, percent)
    guests, ways = crowded(labelled, settled(ways))
    rest = expanded(at, ways, percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if not guests.isEmpty():
        apart = differences(labelled.select("node", "n", "comp"), guests, texts, size)
        links = settled(near_heads(apart, percent))
        found = found if links.isEmpty() else joined(links)
        # Members of the host's component that differ little from its head are tried first: one link for a guest is enough.
        for _ in range(ROUNDS):
            near = settled(head_pairs(apart, found, percent, leading=True))
            near = settled(plausible(near.join(tried, ["a", "b"], "left_anti")))
            if near.isEmpty():
                break
            tried = settled(tried.unionAll(near))
            links = verified(near, texts, size, percent)
            if links.isEmpty():
                break
            found = joined(links)
        rest = rest.unionAll(head_pairs(apart, found, percent)).distinct()
    rest = settled(plausible(settled(rest).join(tried, ["a", "b"], "left_anti")))
    if not rest.isEmpty():
        found = joined(verified(rest, texts, size, percent))

    named = classes.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    ids = named.groupBy("comp").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    ids = settled(named.select("node", "comp", "docs").join(ids, "comp").where((F.col("docs") > 1) | (F.col("members") > 1)).select("node", "component_id"))
    out = lookup(signed.select("doc_id", "h", "n", "node"), ids.withColumn("linked", F.lit(True)), ["node"])
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4).drop("h")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, in the columns of ``docs``; of repeated rows of it, one."""
    found = cut(near_duplicates(docs))
    rows = found.groupBy("doc_id", "h").agg(F.count("*").alias("n"), F.first("kept").alias("kept")).where("n > 1 or not kept")
    rows = cut(rows.select("doc_id", F.col("h").alias("__h"), F.col("kept").alias("__kept")))
    marked = lookup(docs.withColumn("__h", F.xxhash64("text")), rows, ["doc_id", "__h"], salts=1)
    single = marked.where("__kept is null")
    return single.unionAll(marked.where("__kept").dropDuplicates(["doc_id", "__h"])).select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN trim(coalesce(text, ''), e' \t\n\x0b\x0c\r') = '' THEN [] ELSE regexp_split_to_array(trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), e' \t\n\x0b\x0c\r'), '[\x20\x09-\x0D]+') END AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 4 THEN array_to_string(ws[i:i+3], ' ') ELSE array_to_string(ws, ' ') END AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM i JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY 1) m ON d.doc_id = m.x
"""

QUERIES = {"op9_minhash_near_dedup": op9_minhash_near_dedup}
ORACLES = {"op9_minhash_near_dedup": ORACLE}
