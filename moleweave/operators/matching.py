"""Substructure search over molecule rows, projections that do not shuffle, and the exact search for common parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moleweave.functions.alignment import MOST_STEPS, STATE, mol_common_pattern, searched
from moleweave.functions.graphs import default_valence, is_transition_metal
from moleweave.functions.molecules import indices
from moleweave.functions.smarts import matches, mol_matches_each, pattern_needs, query_bonds
from moleweave.operators.molecules import cut, stage


def with_matches(mols: DataFrame, smarts: str, uniquify: bool = True, name: str = "matches") -> DataFrame:
    """Add the matches of a pattern, as arrays of atom indices in the order of the query's atoms.

    Rows that lack an element of the pattern are screened out before the search.
    """
    return mols.withColumn(name, F.explode(F.array(matches(smarts, uniquify=uniquify))))


def match_rows(mols: DataFrame, smarts: str, *keys: str, uniquify: bool = True) -> DataFrame:
    """A row (keys, match_no, match) for each match."""
    return mols.select(*keys, F.posexplode(matches(smarts, uniquify=uniquify)).alias("match_no", "match"))


def first_match(smarts: str) -> Column:
    """The first match; null if there is none."""
    return F.get(matches(smarts), F.lit(0))


def match_union(found: Column) -> Column:
    """The atoms that are in any match, in order."""
    return F.array_sort(F.array_distinct(F.flatten(found)))


def match_bonds(smarts: str, match: Column) -> Column:
    """Indices of the bonds on which the query's bonds lie, in the order of the pattern; null for no match."""
    def index(x: Column) -> Column:
        a, b = F.get(match, F.get(x, F.lit(0))), F.get(match, F.get(x, F.lit(1)))
        hit = F.filter(F.get(F.col("atoms"), a)["near"], lambda n: n["v"] == b)
        return F.get(hit, F.lit(0))["k"]

    return F.when(match.isNotNull(), F.transform(query_bonds(smarts), index))


def unmatched_atoms(match: Column) -> Column:
    """The atoms that a match leaves out; all of them for no match."""
    every = indices(F.size("atoms"))
    return F.when(match.isNull(), every).otherwise(F.array_except(every, match))


def induced_bonds(atom_set: Column) -> Column:
    """Bonds with both ends in a set of atoms."""
    return F.transform(F.filter("bonds", lambda b: F.array_contains(atom_set, b["a"]) & F.array_contains(atom_set, b["b"])), lambda b: b["idx"])


def dative_bonds(mols: DataFrame, donors: tuple[int, ...] = (7, 8)) -> DataFrame:
    """Single bonds from a donor with more than its usual valence to a transition metal become dative, donor first."""
    atom = lambda v: F.get(F.col("atoms"), v)
    gives = lambda d, m: atom(d)["z"].isin(*donors) & F.coalesce(atom(d)["explicit_valence"] > default_valence(atom(d)["z"]), F.lit(False)) & is_transition_metal(atom(m)["z"])

    def rewritten(b: Column) -> Column:
        single = b["kind"] == "SINGLE"
        turned = lambda d, m: b.withField("a", d).withField("b", m).withField("kind", F.lit("DATIVE"))
        return F.when(single & gives(b["a"], b["b"]), turned(b["a"], b["b"])).when(single & gives(b["b"], b["a"]), turned(b["b"], b["a"])).otherwise(b)

    return mols.withColumn("bonds", F.transform("bonds", rewritten))


#: Patterns of one feature that a molecule is given at once, and tasks that a feature of many molecules is dealt to.
PATTERNS, SALTS = 64, 16


def read_patterns(patterns: DataFrame, smarts: str = "smarts") -> DataFrame:
    """``patterns`` with pattern_error, null for a text that is a pattern, and needs, what a molecule has if it matches."""
    read = stage(patterns, __p=pattern_needs(smarts))
    return read.withColumn("pattern_error", F.col("__p.error")).withColumn("needs", F.col("__p.needs")).drop("__p")


def match_table(mols: DataFrame, patterns: DataFrame, key: str, pattern_key: str, smarts: str = "smarts") -> DataFrame:
    """(key, pattern_key, matches): the matches of every pattern of a table in every molecule, where there are any.

    Each pattern is filed under the feature it needs (an element, or two bonded ones) that the fewest molecules have, and
    molecules meet it there if they have all that it needs; only these are searched. Patterns without a named element meet
    all molecules. Texts that are no patterns match nothing; :func:`read_patterns` says why. Keys are unique and not null.
    """
    pair = lambda b: F.array_sort(F.array(F.get(F.col("atoms"), b["a"])["z"], F.get(F.col("atoms"), b["b"])["z"]))
    features = F.concat(F.transform("atoms", lambda a: a["z"].cast("string")), F.transform("bonds", lambda b: F.array_join(pair(b), "-")), F.array(F.lit("")))
    rows = stage(mols.select(key, "atoms", "bonds", "rings"), __has=F.array_distinct(features))
    asked = read_patterns(patterns.select(pattern_key, F.col(smarts).alias("__text")), "__text").where("pattern_error is null").select(F.col(pattern_key).alias("__id"), "__text", "needs")
    often = rows.select(F.explode("__has").alias("__feature")).groupBy("__feature").agg(F.count("*").alias("__n"))
    filed = asked.select("__id", "__text", "needs", F.explode(F.concat("needs", F.array(F.lit("")))).alias("__feature")).join(often, "__feature", "left")
    rarest = F.min(F.struct(F.coalesce("__n", F.lit(0)), "__feature"))
    filed = filed.groupBy("__id").agg(rarest["__feature"].alias("__feature"), F.first("__text").alias("text"), F.first("needs").alias("needs"))
    sizes = filed.groupBy("__feature").agg(F.ceil(F.count("*") / PATTERNS).alias("__groups"))
    filed = filed.join(sizes, "__feature").groupBy("__feature", F.pmod(F.xxhash64("__id"), "__groups").alias("__group")).agg(F.collect_list(F.struct(F.col("__id").alias("id"), "text", "needs")).alias("__list"))
    filed = cut(filed.drop("__group").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    here = rows.withColumn("__feature", F.explode("__has")).withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    met = here.join(filed, ["__feature", "__salt"])
    fits = F.filter("__list", lambda p: F.size(F.array_except(p["needs"], F.col("__has"))) == 0)
    met = stage(met.select(key, "atoms", "bonds", "rings", fits.alias("__fits")).where(F.size("__fits") > 0), __texts=F.transform("__fits", lambda p: p["text"]))
    hits = met.select(key, "__fits", F.explode(F.array(mol_matches_each("atoms", "bonds", "rings", "__texts"))).alias("__hits"))
    hits = hits.select(key, "__fits", F.explode("__hits").alias("__hit"))
    return hits.select(key, F.get("__fits", F.col("__hit.at"))["id"].alias(pattern_key), F.col("__hit.matches").alias("matches"))


def common_parts(pairs: DataFrame, *keys: str, most: int = MOST_STEPS) -> DataFrame:
    """(keys, atoms, bonds, b_atoms, b_bonds) -> keys, left, right, n_bonds, pattern: the largest connected common part, exactly.

    The keys tell the pairs. Each pair is searched for ``most`` states; what is left of the searches is dealt out as rows of
    a state each, searched on with the best size that any of them has found, and so on until no state is left. Of parts of
    one size the one with the least atoms is taken among those found. Pairs without a common atom have empty parts.
    """
    both = ("atoms", "bonds", "b_atoms", "b_bonds")
    pairs = cut(pairs.select(*keys, *both))
    kinds = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, n_bonds int, n_atoms int, left array<int>, right array<int>, states array<{STATE}>"
    order = F.struct((-F.col("n_bonds")).alias("b"), (-F.col("n_atoms")).alias("a"), "left", "right")
    run = searched(list(keys), most)
    asked = pairs.select(*keys, *both, F.lit(-1).alias("n_bonds"), F.lit(-1).alias("n_atoms"), F.lit(None).cast(STATE).alias("state"))
    best = None
    while True:
        found = cut(asked.mapInArrow(run, schema))
        # A search that finds nothing better gives the size that it began with, without atoms.
        parts = found.where(F.size("left") > 0).select(*keys, "n_bonds", "n_atoms", "left", "right")
        best = parts if best is None else best.unionAll(parts)
        best = cut(best.groupBy(*keys).agg(F.min(order).alias("o")).select(*keys, (-F.col("o.b")).alias("n_bonds"), (-F.col("o.a")).alias("n_atoms"), "o.left", "o.right"))
        states = found.select(*keys, F.explode("states").alias("state"))
        if states.isEmpty():
            break
        # Molecules and states are many times what the size of their texts' table lets Spark expect, so they are not to be broadcast.
        asked = states.hint("merge").join(pairs, [*keys]).join(best.select(*keys, "n_bonds", "n_atoms").hint("merge"), [*keys], "left").fillna(-1, ["n_bonds", "n_atoms"])
        asked = asked.select(*keys, *both, "n_bonds", "n_atoms", "state").repartition(F.xxhash64(*keys, "state"))
    none = F.array().cast("array<int>")
    out = pairs.join(best.drop("n_atoms").hint("merge"), [*keys], "left").withColumns({"left": F.coalesce("left", none), "right": F.coalesce("right", none), "n_bonds": F.coalesce("n_bonds", F.lit(0))})
    return stage(out, pattern=mol_common_pattern(*both, "left", "right")).drop(*both)
