"""Hard negatives by one-dimensional distance keys: exact top lists of inner products without going through all pairs.

Each vector gets one more component that gives all of them the greatest length, so that the row of greatest inner product
with an anchor is the nearest one. A row's key is its nearest pivot and the distance to it, and the table is stored sorted
by that key, in shards of neighbouring keys. By the triangle inequality a row at distance d of a pivot is no nearer to an
anchor than the difference of d and the anchor's own distance of that pivot. An anchor first searches the shard in which
it lies itself, which bounds its top list, and then the shards with keys within that bound. In a shard, intervals of keys
are scanned outwards, twice as many in each step, until the bound of the rest certifies the list.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moleweave.llm.common import cut, keep, lookup, table

#: Pivots, and the rows they are fitted on: those of least hashed id. Results do not depend on either.
PIVOTS, SAMPLE, FIT_ROUNDS = 32, 2048, 8
#: About how many rows a shard has, how many rows an interval of keys has at most, and how many anchors come to a shard at once.
SHARD_ROWS, INTERVAL_ROWS, ANCHORS = 2048, 256, 8192
#: A pivot's shards are repeated under so many salts to find the shards of each anchor.
SALTS = 16
#: Allowance for rounding of distances, as a share of the greatest squared length; a distance near 0 is off by the root of that of its square.
SLACK = 1e-6
#: Scores are longs.
MOST = (1 << 63) - 1
FOUND = "anchor_id long, slot int, score long, vec_id long"


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, one for each id.

    Rows without an id, without a label or vector, or with a null or non-finite component take no part. Rows repeated
    exactly count once; of different rows with one id the least by label and components stands for the id.
    """
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    several = cut(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1"))
    marked = lookup(rows, several, ["vec_id"])
    one = marked.where("n > 1").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("least"))
    return marked.where("n is null").drop("n").unionAll(one.select("vec_id", "least.label", "least.v"))


def fitted_pivots(sample: np.ndarray, k: int = PIVOTS) -> np.ndarray:
    """``k`` points spread over the sample, each moved to the mean of what is nearest to it a few times."""
    chosen = sample[np.linspace(0, len(sample) - 1, min(k, len(sample))).astype(int)].copy()
    for _ in range(FIT_ROUNDS):
        near = distances(sample, chosen).argmin(1)
        for j in range(len(chosen)):
            if (near == j).any():
                chosen[j] = sample[near == j].mean(0)
    return np.unique(chosen, axis=0)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))


def padded(vectors, width: int) -> np.ndarray:
    """Vectors of doubles in a matrix; those that are shorter end with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def unpacked(packed, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(packed), kind).reshape(-1, width)


def from_pivots(q: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of anchors, whose added component is 0, from the pivots."""
    return distances(np.concatenate([q.astype(float), np.zeros((len(q), 1))], 1), pivots)


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]], 1)


def keyed(rows: DataFrame, pivots: np.ndarray, most: float, width: int, kind: str) -> DataFrame:
    """vec_id, label, packed vector, pivot, its distance, and the shard: the table sorted by (pivot, distance)."""
    def run(frames):
        for f in frames:
            x = padded(f["v"], width)
            near = distances(augmented(x, most), pivots)
            packed = [r.tobytes() for r in x.astype(kind)] if kind != "<i8" else [np.array([*v, *[0] * (width - len(v))], "<i8").tobytes() for v in f["v"]]
            yield pd.DataFrame({"vec_id": f["vec_id"], "label": f["label"], "v": packed, "pivot": near.argmin(1).astype(np.int32), "distance": near.min(1)})

    out = rows.mapInPandas(run, "vec_id long, label long, v binary, pivot int, distance double")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    out = out.repartitionByRange(shards, "pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
    return keep(out.withColumn("shard", F.spark_partition_id()), "keyed")


def intervals(pivot: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of one pivot, at most INTERVAL_ROWS rows long, of sorted keys."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(pivot)) + 1, [len(pivot)]])
    starts = np.concatenate([np.arange(a, b, INTERVAL_ROWS) for a, b in zip(edges, edges[1:])])
    return starts, np.append(starts[1:], len(pivot))


def best(anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Which candidates are among the first ``k`` of their anchor and slot."""
    order = np.lexsort((vec_id, -score, slot, anchor))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(anchor[order]) != 0) | (np.diff(slot[order]) != 0)
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]


def searcher(pivots: np.ndarray, most: float, width: int, kind: str, k: int, same: bool):
    """The search of one shard for a group of anchors: the first ``k`` of each anchor's slots, of its own label or of others."""
    exact = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object

    def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(anchors):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("anchor_id", "slot", "score", "vec_id")})
        rows = rows.sort_values(["pivot", "distance", "vec_id"])
        x, q = (unpacked(f["v"], width, kind) for f in (rows, anchors))
        ids, label, pivot, distance = (rows[c].to_numpy() for c in ("vec_id", "label", "pivot", "distance"))
        names, own = anchors["anchor_id"].to_numpy(), anchors["label"].to_numpy()
        slots = max(map(len, anchors["uppers"]))
        upper, floor = (np.array([[*u, *[fill] * (slots - len(u))] for u in anchors[c]], np.int64) for c, fill in (("uppers", -MOST), ("floors", MOST)))
        start, end = intervals(pivot, distance)
        to_pivot = from_pivots(q, pivots)[:, pivot[start]]
        gap = np.maximum(np.maximum(distance[start] - to_pivot, to_pivot - distance[end - 1]), 0)
        reach = (np.square(q, dtype=float).sum(1)[:, None] + most - gap**2) / 2 + SLACK * most
        order = np.argsort(-reach, axis=1)
        x, q = x.astype(exact), q.astype(exact)
        held = [np.zeros(0, np.int64) for _ in range(4)]
        done, step = 0, 1
        while done < len(start):
            lowest, highest = floor.min(1), upper.max(1)
            asked = order[:, done:done + step]
            who, what = np.nonzero(np.take_along_axis(reach, asked, 1) >= lowest[:, None])
            if not len(who):
                break
            more = [held]
            scanned = asked[who, what]
            for s in np.unique(scanned):
                at, part = who[scanned == s], slice(start[s], end[s])
                score = q[at] @ x[part].T
                score = (score.clip(-MOST, MOST) if exact is object else score).astype(np.int64)
                fits = (score >= lowest[at][:, None]) & (score <= highest[at][:, None]) & ((label[part][None] == own[at][:, None]) == same)
                i, j = np.nonzero(fits & (ids[part][None] != names[at][:, None]))
                for slot in range(slots):
                    ok = (score[i, j] <= upper[at[i], slot]) & (score[i, j] >= floor[at[i], slot])
                    more.append([at[i[ok]], np.full(ok.sum(), slot), score[i[ok], j[ok]], ids[part][j[ok]]])
            held = [np.concatenate(c) for c in zip(*more)]
            held = [c[first] for first in [best(*held, k)] for c in held]
            # A full list raises the floor of its slot to its last score: equal scores can still come in by a lesser id.
            count, least = np.zeros(floor.shape, int), np.full(floor.shape, MOST)
            np.add.at(count, (held[0], held[1]), 1)
            np.minimum.at(least, (held[0], held[1]), held[2])
            floor = np.where(count >= k, np.maximum(floor, least), floor)
            done, step = done + step, step * 2
        return pd.DataFrame({"anchor_id": names[held[0]], "slot": held[1], "score": held[2], "vec_id": held[3]})

    return run


def top(found: DataFrame, k: int) -> DataFrame:
    """(anchor_id, slot, score, vec_id) with its rank, for the first ``k`` of each anchor and slot."""
    rank = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(store: DataFrame, anchors: DataFrame, pivots: np.ndarray, most: float, width: int, kind: str, k: int, same: bool) -> DataFrame:
    """The exact top lists of the anchors (anchor_id, label, v, square, to_pivots, shard, uppers, floors), by slots.

    A slot takes scores from its floor to its upper bound. Each anchor searches its own shard; then its radius is that of
    the least score that can still enter one of its lists, and it goes to the other shards with keys within the radius.
    """
    groups = -(-max(1, anchors.count()) // ANCHORS)
    rows = store.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    run = searcher(pivots, most, width, kind, k, same)

    def search(asked: DataFrame) -> DataFrame:
        asked = asked.select("anchor_id", "label", "v", "shard", "uppers", "floors", F.pmod(F.xxhash64("anchor_id"), F.lit(groups)).cast("int").alias("group"))
        return keep(rows.groupBy("shard", "group").cogroup(asked.groupBy("shard", "group")).applyInPandas(run, FOUND), "found")

    home = search(anchors)
    last = home.groupBy("anchor_id", "slot").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") == k)
    last = last.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("last"))
    raised = lambda u, i: F.greatest(u, F.coalesce(F.element_at("last", i), u))
    anchors = anchors.join(last, "anchor_id", "left").withColumn("floors", F.when(F.col("last").isNull(), F.col("floors")).otherwise(F.transform("floors", raised)))
    radius = F.sqrt(F.greatest(F.col("square") + most * (1 + 4 * SLACK) - 2 * F.array_min("floors").cast("double"), F.lit(0.0)))
    shards = store.groupBy("shard", "pivot").agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"))
    shards = shards.withColumnRenamed("shard", "there").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rays = anchors.select("anchor_id", "shard", radius.alias("r"), F.pmod(F.xxhash64("anchor_id"), F.lit(SALTS)).cast("int").alias("salt"), F.posexplode("to_pivots").alias("pivot", "d"))
    reached = rays.join(shards, ["pivot", "salt"]).where("shard <> there and lo <= d + r and hi >= d - r").select("anchor_id", F.col("there").alias("shard")).distinct()
    return top(home.unionAll(search(anchors.drop("shard").join(reached, "anchor_id"))), k)


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 5, every: int = 100) -> DataFrame:
    """(vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id ``every`` divides. An anchor's positives are the first other rows of its label by inner
    product, ties by lesser id; of each, the first rows of other labels with 80 to 100 % of its score are returned.
    Vectors of different length are compared as if the shorter ended with zeros. Scores beyond longs are held to their
    range. Other columns are ignored; an empty table, or one without anchors, gives an empty result.
    """
    square = F.aggregate("v", F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double"))
    rows = keep(quantised(vectors).withColumn("square", square), "vectors")
    most, width = rows.agg(F.max("square"), F.max(F.size("v"))).first()
    most, width = max(1.0, most or 0.0), max(1, width or 0)
    kind = "<i2" if most < 1 << 30 else "<i8"
    sample = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    pivots = fitted_pivots(augmented(padded([r.v for r in sample], width), most)) if sample else np.zeros((1, width + 1))
    store = keyed(rows, pivots, most, width, kind)

    def towards(frames):
        for f in frames:
            q = unpacked(f["v"], width, kind)
            yield f.assign(square=np.square(q, dtype=float).sum(1), to_pivots=list(from_pivots(q, pivots)))

    anchors = store.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), "label", "v", "shard")
    anchors = keep(anchors.mapInPandas(towards, "anchor_id long, label long, v binary, shard int, square double, to_pivots array<double>"), "anchors")
    open_ = anchors.withColumn("uppers", F.array(F.lit(MOST))).withColumn("floors", F.array(F.lit(-MOST)))
    found = keep(nearest(store, open_, pivots, most, width, kind, positives, True), "positives")
    found = found.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # 80 * p <= 100 * s asks for 4 * p / 5, rounded up; no score is between that and p if p is negative.
    least = F.expr(f"if(positive_score < 0, {MOST}, positive_score - positive_score div 5)").alias("least")
    lists = found.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("slot", "positive_score", least))).alias("all"))
    bounded = anchors.join(lists.select("anchor_id", F.col("all.positive_score").alias("uppers"), F.col("all.least").alias("floors")), "anchor_id")
    against = nearest(store, bounded, pivots, most, width, kind, negatives, False)
    return found.join(against, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


ORACLE = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLES = {"op11_hard_negatives": ORACLE}
