"""Repair of the structure of conversations: the cheapest edits, by Dijkstra on an implicit lattice.

A node is (rows read, state of the grammar of roles); edges keep, rerole or delete the next row or insert an empty turn.
The queue is ordered by (cost, audit), the audit being the edits' initials, and the search stops at the first accepting
end node that it takes out. Rows are sorted by conversation and turn over ranges, so a conversation may lie in several
tasks: a run of rows then gives the cheapest edits from each state to each other, and runs are put together in order.
That is exact: of two ways between the same nodes at the same cost neither audit begins the other, as they read the same
rows, so the lesser stays the lesser whatever follows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moleweave.llm.common import cut, keep, lookup, table

NOT_BLANK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
#: Role initials are (s?(ua)+)?: START before any turn, then the initial of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FOLLOWS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
ACCEPTING = (START, ASSISTANT)
LEGAL = ("su", "ua", "au")
RELABEL, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Turns of one conversation that a task searches at once; longer ones are put together of such runs.
RUN = 1024
#: The longest that a number of turns can be.
MOST = (1 << 63) - 1

Item = tuple[str, bool, bool]  # initial of the role, whether the turn has to go, whether it is truncated


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): every twentieth row dropped, emptied, left without stops, repeated or made the user's.

    A dropped row leaves a row of no times, so that its conversation is not lost. Nulls of role and text become a space.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), fate.alias("fate"))
    gone = F.col("fate") == 0
    return rows.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone | (F.col("fate") == 1), "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(gone, 0).when(F.col("fate") == 3, 2).otherwise(1).alias("times"),
    )


def faulty(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times) with equal rows as one, and the first fault of the first of them."""
    place = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    spoken = rows.where((F.col("times") > 0) & F.col("text").rlike(NOT_BLANK))
    again = spoken.groupBy("conv_id", "role", F.md5("text").alias("key")).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    again = cut(again.select("conv_id", "role", "key", F.col("first.turn").alias("first"), F.lit(True).alias("several")))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    rows = lookup(rows.withColumn("key", F.md5("text")), again, ["conv_id", "role", "key"])
    fault = F.when(~F.col("text").rlike(NOT_BLANK), "blank").when(F.col("several") & ~F.col("turn").eqNullSafe(F.col("first")), "duplicate")
    return rows.select("conv_id", "turn", "role", "text", "times", fault.when(~F.col("text").rlike(ENDED), "truncated").alias("fault"))


def items(rows: Iterable[dict]) -> Iterator[Item]:
    for r in rows:
        for k in range(r["times"]):
            yield r["role"][:1], k > 0 or r["fault"] in ("blank", "duplicate"), r["fault"] == "truncated"


def cheapest(turns: list[Item], start: int = START, ends: tuple[int, ...] | None = ACCEPTING) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) from a state to the first of the ends that is reached; to every state if ``ends`` is None."""
    queue, done, found = [(0, "", 0, start)], set(), {}
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(turns) and (ends is None or state in ends):
            found[state] = (cost, audit)
            if ends is not None:
                break
        heapq.heappush(queue, (cost + INSERT, audit + "I", i, FOLLOWS[state]))
        if i < len(turns):
            initial, goes, cut_off = turns[i]
            heapq.heappush(queue, (cost + DELETE, audit + "D", i + 1, state))
            if not goes:
                if (state, initial) in NEXT:
                    heapq.heappush(queue, (cost + TRUNCATED * cut_off, audit + "K", i + 1, NEXT[state, initial]))
                heapq.heappush(queue, (cost + RELABEL + TRUNCATED * cut_off, audit + "R", i + 1, FOLLOWS[state]))
    return found


Ways = dict[tuple[int, int], tuple[int, str]]


def ways(turns: list[Item]) -> Ways:
    return {(a, b): found for a in (START, SYSTEM, USER, ASSISTANT) for b, found in cheapest(turns, a, None).items()}


def followed(one: Ways, two: Ways) -> Ways:
    """The cheapest edits over two runs, one after the other."""
    out: Ways = {}
    for (a, m), (cost, audit) in one.items():
        for b in range(4):
            if (m, b) in two:
                new = (cost + two[m, b][0], audit + two[m, b][1])
                out[a, b] = min(out.get((a, b), new), new)
    return out


class Figures:
    """Counts of a conversation's turns and the hash of its repaired text, as its rows pass in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.begun = audit, 0, START, hashlib.sha256(), False
        self.count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.last = self.role = None
        self.turns = 0

    def say(self, role: str, text: str) -> None:
        self.hash.update(f"{'\n' if self.begun else ''}{role}:{text}".encode())
        self.begun = True

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = FOLLOWS[self.state]
            self.say(ROLE[self.state], "")
            self.at += 1

    def take(self, row: dict) -> None:
        turn = row["turn"]
        if row["times"] and turn is not None and turn != self.last:
            self.low, self.high, self.last, self.turns = turn if self.low is None else self.low, turn, turn, self.turns + 1
        for k in range(row["times"]):
            fault = row["fault"] if k == 0 or row["fault"] == "blank" else "duplicate"
            if fault:
                self.count[fault] += 1
            initial = row["role"][:1]
            self.count["illegal"] += self.role is not None and self.role + initial not in LEGAL
            self.role = initial
            self.inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.state = NEXT[self.state, initial]
                self.say(row["role"], row["text"])
            elif edit == "R":
                self.state = FOLLOWS[self.state]
                self.say(ROLE[self.state], row["text"])

    def result(self, conv_id, cost: int) -> dict:
        self.inserted()
        gaps = 0 if self.low is None else min(MOST, self.high - self.low + 1 - self.turns)
        return {"conv_id": conv_id, "gaps": gaps, **self.count, "cost": cost, "audit": self.audit, "repaired_sha256": self.hash.hexdigest()}


FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
WAYS = "array<struct<a:int,b:int,cost:long,audit:string>>"


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def written(rows: Iterator[dict], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def first_pass(schema: pa.Schema):
    """Sorted rows -> a row with its figures for each conversation that lies within; the ways of a run of any other."""
    def finished(conv_id, rows: list[dict], so_far: Ways | None, edge: bool, part: int) -> dict:
        if so_far is None and not edge:
            cost, audit = next(iter(cheapest(list(items(rows))).values()))
            figures = Figures(audit)
            for r in rows:
                figures.take(r)
            return figures.result(conv_id, cost)
        own = ways(list(items(rows)))
        all_ways = followed(so_far, own) if so_far else own
        return {"conv_id": conv_id, "part": part, "ways": [{"a": a, "b": b, "cost": c, "audit": s} for (a, b), (c, s) in all_ways.items()]}

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[dict] = []
        so_far, size, first = None, 0, True
        for r in read(batches):
            if held and r["conv_id"] != held[-1]["conv_id"]:
                yield finished(held[-1]["conv_id"], held, so_far, first, held[-1]["part"])
                held, so_far, size, first = [], None, 0, False
            while size + r["times"] > RUN:
                now = RUN - size
                run = ways([*items(held), *items([{**r, "times": now}])] if now else list(items(held)))
                so_far = followed(so_far, run) if so_far else run
                # What is left of a row of which a part has gone are repeats.
                held, size = [], 0
                r = {**r, "times": r["times"] - now, "fault": r["fault"] if not now or r["fault"] == "blank" else "duplicate"}
            held.append(r)
            size += r["times"]
        if held:
            yield finished(held[-1]["conv_id"], held, so_far, True, held[-1]["part"])

    return lambda batches: written(passed(batches), schema)


def put_together(runs: pa.Table) -> pa.Table:
    """A conversation's runs in order -> its cheapest edits."""
    total: Ways | None = None
    rows = sorted(runs.to_pylist(), key=lambda r: r["part"])
    for r in rows:
        own = {(w["a"], w["b"]): (w["cost"], w["audit"]) for w in r["ways"] if total or w["a"] == START}
        total = followed(total, own) if total else own
    cost, audit = min(total[START, b] for b in ACCEPTING if (START, b) in total)
    return pa.table({"conv_id": runs.column("conv_id")[:1], "audit": pa.array([audit]), "cost": pa.array([cost], pa.int64())})


def second_pass(schema: pa.Schema):
    """Sorted rows, with a row that has the edits before each conversation's -> its figures."""
    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        figures, conv_id, cost = None, None, 0
        for r in read(batches):
            if r["audit"] is not None:
                if figures:
                    yield figures.result(conv_id, cost)
                figures, conv_id, cost = Figures(r["audit"]), r["conv_id"], r["cost"]
            else:
                figures.take(r)
        if figures:
            yield figures.result(conv_id, cost)

    return lambda batches: written(passed(batches), schema)


def arrow_schema(spark: SparkSession, kind: T.DataType, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(ddl)]))


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), damaged -> the figures of each conv_id, null too, and its cheapest repair.

    Rows of one turn are taken by role and text; a role without an initial can be kept nowhere. Conversations of which
    no row is left have zeros, an empty audit and the hash of the empty text; an empty table gives an empty result. Equal
    rows are one row with its number until they are read. A conversation's edits and the hash of its text are single
    values, so one task reads each conversation that is not in one range of its own from end to end, without holding its
    rows. Other columns are ignored.
    """
    spark = conversations.sparkSession
    conversations = conversations.select("conv_id", "turn", "role", "text")
    kind = conversations.schema["conv_id"].dataType
    order = ["conv_id", "turn", "role", "text"]
    rows = faulty(damaged(conversations))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = f"conv_id {kind.simpleString()}, {FIGURES}"
    first_ddl = f"{FIGURES}, part int, ways {WAYS}"
    first = keep(ordered.mapInArrow(first_pass(arrow_schema(spark, kind, first_ddl)), f"conv_id {kind.simpleString()}, {first_ddl}"), "repairs")

    edits = first.where("ways is not null").select("conv_id", "part", "ways").groupBy("conv_id").applyInArrow(put_together, f"conv_id {kind.simpleString()}, audit string, cost long")
    edits = keep(edits, "edits")
    open_ = faulty(damaged(lookup(conversations, edits.select("conv_id", F.lit(1).alias("asked")), ["conv_id"], "inner").select(*conversations.columns)))
    none = lambda **kinds: [F.lit(None).cast(k).alias(c) for c, k in kinds.items()]
    heads = edits.select("conv_id", *none(turn="long", role="string", text="string", times="long", fault="string"), "audit", "cost", F.lit(0).alias("rank"))
    stream = heads.unionAll(open_.select(*order, "times", "fault", *none(audit="string", cost="long"), F.lit(1).alias("rank")))
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "rank", "turn", "role", "text")
    second = stream.mapInArrow(second_pass(arrow_schema(spark, kind, FIGURES)), schema)
    return first.where("ways is null").select(second.columns).unionAll(second)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))


#: The damage and the faults are plain SQL; the repair goes through the turns of all conversations at once and keeps the
#: least (cost, audit) of each state, with up to two turns inserted before each row.
ORACLE = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS b FROM conversations),
h AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x:
    list_reduce(list_concat([xor(c, x)], range(8)), lambda y, i: xor(y >> 1, 3988292384::BIGINT * (y & 1)))), 4294967295::BIGINT) % 20 AS f FROM k),
d AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM h WHERE f <> 0),
n AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, lag(role[1]) OVER w AS before
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
t AS (
  SELECT conv_id, turn, role, text, i, before, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault FROM n),
c AS (
  SELECT conv_id, max(i) AS size, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal
  FROM t GROUP BY 1),
ins(st, nx, cost, audit, said) AS (VALUES ('', '', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('a', 'a', 0, '', ''),
  ('', 'u', 2, 'I', e'\nuser:'), ('s', 'u', 2, 'I', e'\nuser:'), ('u', 'a', 2, 'I', e'\nassistant:'), ('a', 'u', 2, 'I', e'\nuser:'),
  ('', 'a', 4, 'II', e'\nuser:\nassistant:'), ('s', 'a', 4, 'II', e'\nuser:\nassistant:'), ('u', 'u', 4, 'II', e'\nassistant:\nuser:'), ('a', 'a', 4, 'II', e'\nuser:\nassistant:')),
go(st, own, nx, edit, cost) AS (
  SELECT st, NULL::VARCHAR, st, 'D', 3 FROM (VALUES (''), ('s'), ('u'), ('a')) v(st)
  UNION ALL SELECT st, NULL::VARCHAR, CASE st WHEN 'u' THEN 'a' ELSE 'u' END, 'R', 2 FROM (VALUES (''), ('s'), ('u'), ('a')) v(st)
  UNION ALL VALUES ('', 's', 's', 'K', 0), ('', 'u', 'u', 'K', 0), ('s', 'u', 'u', 'K', 0), ('u', 'a', 'a', 'K', 0), ('a', 'u', 'u', 'K', 0)),
r AS (
  SELECT conv_id, 0::BIGINT AS i, '' AS st, {'cost': 0, 'audit': '', 'said': ''} AS best FROM c
  UNION ALL
  SELECT r.conv_id, t.i, go.nx, min({'cost': (best.cost + ins.cost + go.cost + CASE WHEN t.fault = 't' AND edit <> 'D' THEN 1 ELSE 0 END)::INTEGER, 'audit': best.audit || ins.audit || edit,
    'said': best.said || ins.said || CASE edit WHEN 'D' THEN '' WHEN 'K' THEN e'\n' || t.role || ':' || t.text ELSE e'\n' || CASE go.nx WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || t.text END})
  FROM r JOIN t ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = r.i + 1 JOIN ins ON ins.st = r.st
    JOIN go ON go.st = ins.nx AND (go.own IS NULL OR go.own = t.role[1]) AND (edit = 'D' OR t.fault NOT IN ('b', 'd'))
  GROUP BY 1, 2, 3),
z AS (
  SELECT r.conv_id, min({'cost': (best.cost + ins.cost)::INTEGER, 'audit': best.audit || ins.audit, 'said': best.said || ins.said}) AS best
  FROM r JOIN c ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = c.size JOIN ins ON ins.st = r.st WHERE ins.nx IN ('', 'a') GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.said[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON o.conv_id IS NOT DISTINCT FROM z.conv_id
"""

QUERIES = {"op12_conversation_repair": op12_conversation_repair}
ORACLES = {"op12_conversation_repair": ORACLE}
