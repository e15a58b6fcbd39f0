"""Toxicity by a lexicon of learned terms, found with misspellings too, and the contexts in which they stand.

Terms are words and beginnings of words that labelled toxic documents have more often than clean ones. Their trie is
intersected with the Levenshtein automaton of one edit: the states of the product, sets of (trie node, edits spent), are
made as words lead to them and kept, so a word costs a step for each letter until no term is in reach. Each find is
weighed by a window around it: quoted or reported terms count less than those said to somebody. A logistic regression
over the weighed finds gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moleweave.llm.common import keep, table

#: Labelled rows of each class that the fit sees, those of least hashed id; terms of the lexicon; forms that are no misspellings.
TOXIC_ROWS, CLEAN_ROWS, TERMS, FORMS = 4096, 8192, 2048, 8192
#: Letters of a term; a term with an end mark is a whole word. Shorter terms are found as they are spelt alone.
SHORTEST, LONGEST, SPELT_ALONE, END = 4, 10, 5, "$"
#: A document counts in full for a term that it has so often, and for a part of that if it has it less often.
OFTEN = 3
#: Toxic documents that must have a term, and the least logarithm of odds of a term and of a strong one.
LEAST_ROWS, LEAST_ODDS, STRONG_ODDS = 3, 1.2, 3.5
#: Words whose finds a task keeps.
KEPT_WORDS = 1 << 17
#: Words on each side of a find that are looked at, and words within which finds make a peak.
WINDOW, PEAK = 8, 40
#: How much a find counts: quoted with a word of reporting near, quoted, reported, said to somebody.
QUOTED_REPORTED, QUOTED, REPORTED, ADDRESSED = 0.1, 0.3, 0.7, 1.3
#: Words of reporting, and words by which somebody is addressed.
REPORTING = frozenset("said says wrote writes called calls quoted quotes quote word words term insult insults slur means meaning sagte schrieb nannte wort bedeutet dit écrit appelle mot signifie dijo escribió llamó palabra significa".split())
ADDRESS = frozenset("you your you're u ur du dich dir dein ihr euch tu te toi ton vous votre tú ti usted ustedes".split())
OPENING, CLOSING = "\"'“«„‘‚‹", "\"'”»“’‘›"
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
FEATURES = 10


def spoken(text: str | None) -> tuple[list[str], list[str]]:
    """The words between white space, and the same in lower case without what is at their edges and is no letter or digit."""
    raw = (text or "").split()
    bare = [w if w.isalnum() else EDGES.sub("", w) for w in raw]
    return raw, [w.lower() for w in bare]


def beginnings(word: str) -> list[str]:
    return [word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1)] + ([word + END] if SHORTEST <= len(word) <= LONGEST else [])


class Lexicon:
    """Terms with their weights, by the number of edits, as a trie crossed with the automaton of one edit."""

    def __init__(self, exact: dict[str, float], misspelt: dict[str, float], usual: frozenset[str] = frozenset()):
        self.exact, self.misspelt, self.usual = exact, misspelt, usual
        self.children: list[dict[str, int]] = [{}]
        self.term: dict[int, str] = {}
        self.whole: dict[int, str] = {}
        for t in sorted(exact):
            node = 0
            for c in t.removesuffix(END):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            (self.whole if t.endswith(END) else self.term)[node] = t
        self.letters = {c for node in self.children for c in node}
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.begun: list[tuple[int, str] | None] = []
        self.ended: list[tuple[int, str] | None] = []
        self.kept: dict[str, tuple[int, str] | None] = {}
        self.dead = self.number({})
        self.start = self.number({0: 0})

    def number(self, state: dict[int, int]) -> int:
        """The number of a state: the nodes in reach with the fewest edits spent, terms' letters left out included."""
        for node, spent in list(state.items()):
            if spent == 0:
                for child in self.children[node].values():
                    state.setdefault(child, 1)
        key = frozenset(state.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            self.begun.append(self.least(self.term, key))
            self.ended.append(self.least(self.whole, key))
        return self.numbers[key]

    def least(self, terms: dict[int, str], state: frozenset) -> tuple[int, str] | None:
        found = ((spent, terms[node]) for node, spent in state if node in terms and (spent == 0 or terms[node] in self.misspelt))
        return min(found, key=self.rank, default=None)

    def rank(self, find: tuple[int, str]) -> tuple:
        return find[0], -self.exact[find[1]], find[1]

    def step(self, at: int, c: str) -> int:
        after: dict[int, int] = {}
        for node, spent in self.states[at]:
            for letter, child in self.children[node].items():
                cost = spent + (letter != c)
                if cost <= 1:
                    after[child] = min(after.get(child, cost), cost)
            if spent == 0:
                after[node] = min(after.get(node, 1), 1)
        return self.number(after)

    def find(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the term that a word is or begins with, as spelt before misspelt; None for usual words."""
        if word not in self.kept:
            if len(self.kept) >= KEPT_WORDS:
                self.kept.clear()
            self.kept[word] = self.sought(word)
        return self.kept[word]

    def sought(self, word: str) -> tuple[int, str] | None:
        at, finds = self.start, []
        for c in word:
            c = c if c in self.letters else ""
            steps = self.steps[at]
            if c not in steps:
                steps[c] = self.step(at, c)
            at = steps[c]
            if at == self.dead:
                break
            if self.begun[at]:
                finds.append(self.begun[at])
        if self.ended[at]:
            finds.append(self.ended[at])
        best = min(finds, key=self.rank, default=None)
        return None if best and best[0] and word in self.usual else best

    def weight(self, edits: int, term: str) -> float:
        return self.misspelt[term] if edits else self.exact[term]


def quoted(raw: list[str]) -> list[bool]:
    """Whether each word is between quotation marks; a mark that is not closed within 40 words opens nothing."""
    out, opened = [False] * len(raw), None
    for i, w in enumerate(raw):
        if opened is not None and i - opened > 40:
            opened = None
        if opened is None and w[0] in OPENING:
            opened = i
        tail = w.rstrip(".,;:!?)")
        if opened is not None and tail and tail[-1] in CLOSING and (i > opened or len(tail) > 1):
            out[opened:i + 1] = [True] * (i + 1 - opened)
            opened = None
    return out


def factor(i: int, words: list[str], inside: bool) -> float:
    near = {*words[max(0, i - WINDOW):i], *words[i + 1:i + 1 + WINDOW]}
    told = not near.isdisjoint(REPORTING)
    if inside:
        return QUOTED_REPORTED if told else QUOTED
    return (REPORTED if told else 1.0) * (1.0 if near.isdisjoint(ADDRESS) else ADDRESSED)


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """What the regression sees of a whole text; all zeros for one without finds, however long it is."""
    raw, words = spoken(text)
    known = {w: f for w in set(words) if (f := lexicon.find(w))}
    if not known:
        return [0.0] * FEATURES
    marks = quoted(raw)
    at = [i for i, w in enumerate(words) if w in known]
    counted = [factor(i, words, marks[i]) for i in at]
    strong = weak = missed = total = 0.0
    for i, much in zip(at, counted):
        edits, term = known[words[i]]
        value = lexicon.weight(edits, term)
        total += much * value
        missed += much * (edits > 0)
        if value >= STRONG_ODDS:
            strong += much
        else:
            weak += much
    peak, first, now = 0.0, 0, 0.0
    for k, i in enumerate(at):
        now += counted[k]
        while i - at[first] >= PEAK:
            now -= counted[first]
            first += 1
        peak = max(peak, now)
    share = min(10.0, 100 * (strong + weak) / (len(words) + 30))
    kinds = len({known[words[i]][1] for i in at if lexicon.weight(*known[words[i]]) >= STRONG_ODDS})
    return [1.0, math.log1p(strong), math.log1p(weak), math.log1p(weak) ** 2, math.log1p(total), math.log1p(missed), math.log1p(kinds), math.log1p(peak), share, math.log1p(len(words))]


class Model(NamedTuple):
    lexicon: tuple[dict[str, float], dict[str, float], frozenset[str]]
    weights: np.ndarray
    bias: float


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, weight): the bounded sample of the rows whose labels may be learned from, one for each id.

    Ids with both labels, or none, are left out. Weights give the classes the shares that they have of all labels.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id")) != 0))
    own = own.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    sample = None
    for toxic, bound in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)):
        of = own.where(F.col("toxic") == toxic)
        part = of.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).withColumn("weight", F.greatest(F.lit(of.count() / bound), F.lit(1.0)))
        sample = part if sample is None else sample.unionAll(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("weight").alias("weight")).drop("doc_id")


def odds(toxic: float, clean: float, n_toxic: int, n_clean: int, prior: float = 0.0) -> float:
    """The logarithm of the ratio of two shares of documents, drawn towards ``prior``."""
    tilt = math.exp(prior / 2)
    return math.log((toxic + 0.5 * tilt) / (n_toxic + 1)) - math.log((clean + 0.5 / tilt) / (n_clean + 1))


def counted(names: list[list[str]], seen: tuple[Counter, Counter], keys: list) -> pa.RecordBatch:
    columns = [*(pa.array(n, pa.string()) for n in names), *(pa.array([seen[toxic][k] for k in keys], pa.int64()) for toxic in (1, 0))]
    return pa.RecordBatch.from_arrays(columns, [*("term", "form")[: len(names)], "toxic", "clean"])


def learned_terms(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """The terms and their weights. Of terms that begin with each other the one that tells most is taken, and of equal ones the longest."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                own: Counter = Counter()
                for w, n in Counter(spoken(text)[1]).items():
                    for t in beginnings(w):
                        own[t] += n
                seen[toxic].update({t: min(n, OFTEN) for t, n in own.items()})
            both = list(seen[0].keys() | seen[1].keys())
            yield counted([both], seen, both)

    counts = sample.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg((F.sum("toxic") / OFTEN).alias("toxic"), (F.sum("clean") / OFTEN).alias("clean"))
    counts = counts.where((F.col("toxic") >= LEAST_ROWS) & (F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1)) >= LEAST_ODDS))
    # Likelihood ratio of having the term given the label.
    part = lambda x, n: F.when(x > 0, x * F.log(x / n)).otherwise(0.0)
    a, b = F.col("toxic"), F.col("clean")
    tells = part(a, (a + b) * n_toxic / (n_toxic + n_clean)) + part(b, (a + b) * n_clean / (n_toxic + n_clean))
    rest = n_toxic + n_clean - a - b
    tells = tells + part(n_toxic - a, rest * n_toxic / (n_toxic + n_clean)) + part(n_clean - b, rest * n_clean / (n_toxic + n_clean))
    rows = counts.orderBy(F.desc(F.round(tells, 6)), F.desc(F.length("term")), "term").limit(8 * TERMS).collect()
    taken: dict[str, float] = {}
    prefixes: set[str] = set()
    for r in rows:
        if r.term not in prefixes and not any(r.term[:n] in taken for n in range(SHORTEST, len(r.term))) and len(taken) < TERMS:
            taken[r.term] = odds(r.toxic, r.clean, n_toxic, n_clean)
            prefixes |= {r.term[:n] for n in range(1, len(r.term) + 1)}
    return taken


def learned_spellings(sample: DataFrame, exact: dict[str, float], n_toxic: int, n_clean: int) -> tuple[dict[str, float], frozenset[str]]:
    """Weights of terms misspelt, where toxic documents have them rather than clean ones, and forms that clean documents have.

    A form of at least two clean documents, and of no fewer than toxic ones at their share, is a word of its own.
    """
    long_ = {t: w for t, w in exact.items() if len(t) - t.endswith(END) >= SPELT_ALONE}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(exact, long_)
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                finds = ((w, lexicon.find(w)) for w in set(spoken(text)[1]))
                seen[toxic].update({(x[1], w) for w, x in finds if x and x[0]})
            both = list(seen[0].keys() | seen[1].keys())
            yield counted([[t for t, _ in both], [w for _, w in both]], seen, both)

    forms = sample.mapInArrow(count, "term string, form string, toxic long, clean long").groupBy("term", "form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    forms = keep(forms, "spellings")
    own = (F.col("clean") >= 2) & (F.col("clean") * n_toxic >= F.col("toxic") * n_clean * 0.5)
    usual = frozenset(r.form for r in forms.where(own).orderBy(F.desc("clean"), "form").limit(FORMS).collect())
    rest = {r.term: (r.toxic, r.clean) for r in forms.where(~own).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()}
    weights = {t: odds(*rest.get(t, (0, 0)), n_toxic, n_clean, prior=w) for t, w in long_.items()}
    return {t: min(w, exact[t]) for t, w in weights.items() if w >= LEAST_ODDS}, usual


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled sample; without labels of both classes one that scores every text with the share of toxic labels."""
    sample = keep(labelled(docs, labels), "labelled")
    rows = {r.toxic: (r.n, r.share) for r in sample.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("weight").alias("share")).collect()}
    if len(rows) < 2:
        return Model(({}, {}, frozenset()), np.zeros(FEATURES), -4.0 if 1 not in rows else 4.0)
    n_toxic, n_clean = rows[1][0], rows[0][0]
    exact = learned_terms(sample, n_toxic, n_clean)
    lexicon = (exact, *learned_spellings(sample, exact, n_toxic, n_clean))
    seen = keep(sample.select(F.col("toxic").cast("double").alias("label"), "weight", described(lexicon)("text").alias("x")), "features")
    fitted = LogisticRegression(regParam=1e-3, maxIter=100, weightCol="weight").fit(seen.select("label", "weight", array_to_vector("x").alias("features")))
    return Model(lexicon, fitted.coefficients.toArray(), fitted.intercept)


def described(lexicon: tuple):
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = Lexicon(*lexicon)
        for texts in batches:
            yield pd.Series([features(t, made) for t in texts])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, score, predicted; one row per input row.

    Null and empty texts have no finds and get a score too. Null ids are not held out. Other columns are ignored; an empty
    table gives an empty result.
    """
    x = described(model.lexicon)("text").alias("x")
    rows = docs.select("doc_id", F.explode(F.array(x)).alias("x"))
    linear = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(w)) for w in model.weights]), lambda a, b: a * b), F.lit(float(model.bias)), lambda n, v: n + v)
    rows = rows.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), (1 / (1 + F.exp(-linear))).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op13_toxicity": op13_toxicity}
ORACLES: dict[str, str] = {}
