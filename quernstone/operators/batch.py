"""Many documents resolved at once, with the result of one after the other.

In order, a name joins the earliest node that has it as name or alias when its document comes, else the most similar node there is by
then, else it becomes a node. What a name joins decides which node has its aliases, so later names depend on earlier ones. Here all
names are resolved in rounds: a round resolves each name against what the round before it says of all earlier documents. Names of the first
document do not depend on others, so they are right after one round, those that depend on right ones only after one more, and so on;
when a round changes nothing, all are right, as the dependencies go back in time only. So there are as many rounds as the longest chain of
changes, whatever the number of documents, and each is a fixed number of jobs.

Time is a number: names of document k come at 2k and their keys are there from then on for what comes later; ends of its edges come at 2k + 1, when
its own names are known, and so do the bare nodes that edges add. What is stored has been there since -1. A node is placed by where it was born,
a struct (k, n): n is its number within the document, or its node_seq for what is stored (k = -1).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import nearest
from .graph import THRESHOLD

Kept = Callable[[DataFrame, str], DataFrame]

#: Parts in which a key's earliest holders are looked for before they meet.
SALTS = 16
#: Names of a document, at most, when a name's place becomes one number.
_PLACES = 1 << 24


@dataclass(frozen=True)
class Resolution:
    """names: the names given, with canonical, born and how ("alias", "vector" or "new"); edges: with the names of both ends; bare: (name, k, n) of nodes that only edges name."""

    names: DataFrame
    edges: DataFrame
    bare: DataFrame
    rounds: int


def born(k: Column, n: Column) -> Column:
    return F.struct(k.cast("long").alias("k"), n.cast("long").alias("n"))


def _keys(name: Column, aliases: Column) -> Column:
    """Case-folded names by which a node is found."""
    every = F.array_union(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")))
    return F.explode(F.array_distinct(F.transform(F.filter(every, lambda x: x.isNotNull()), F.lower)))


def _holders(entities: DataFrame, names: DataFrame, bare: DataFrame) -> DataFrame:
    """(key, t, born, node): from which time on a node has a key."""
    stored = entities.select(_keys(F.col("name"), F.col("aliases")).alias("key"), F.lit(-1).cast("long").alias("t"), born(F.lit(-1), F.col("node_seq")).alias("born"), F.col("name").alias("node"))
    given = names.select(_keys(F.col("name"), F.col("aliases")).alias("key"), (2 * F.col("k")).alias("t"), "born", F.col("canonical").alias("node"))
    ends = bare.select(F.lower("name").alias("key"), (2 * F.col("k") + 1).alias("t"), born(F.col("k"), F.col("n")).alias("born"), F.col("name").alias("node"))
    return stored.unionByName(given).unionByName(ends)


def _first_holders(holders: DataFrame) -> DataFrame:
    """(key, t, until, born, node): the earliest-born holder of each key for what comes after ``t`` and not after ``until`` (null: no end).

    Holders of a key that many nodes have are thinned out part by part first: a holder that an earlier-born one of its part precedes never counts.
    """
    each = holders.groupBy("key", "node").agg(F.min("t").alias("t"), F.min("born").alias("born")).withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    for by in (("key", "_salt"), ("key",)):
        before = F.min("born").over(Window.partitionBy(*by).orderBy("t", "born").rowsBetween(Window.unboundedPreceding, -1))
        each = each.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("born") < F.col("_before"))).drop("_before")
    return each.withColumn("until", F.lead("t").over(Window.partitionBy("key").orderBy("t"))).drop("_salt")


def _look_up(rows: DataFrame, firsts: DataFrame, key: str, time: Column) -> DataFrame:
    """``rows`` with ``node`` and ``node_born`` of the earliest-born holder of column ``key`` before ``time``, null where there is none."""
    held = firsts.select(F.col("key").alias("_key"), "t", "until", "node", F.col("born").alias("node_born"))
    then = (F.col(key) == F.col("_key")) & (time > F.col("t")) & (F.col("until").isNull() | (time <= F.col("until")))
    return rows.join(held, then, "left").drop("_key", "t", "until")


def _similar(open_: DataFrame, names: DataFrame, vectors: DataFrame, threshold: float, search: Callable[..., DataFrame]) -> DataFrame:
    """(k, n, node, node_born) for names (k, n, embedding) whose nearest vector of an earlier node reaches the threshold."""
    place = F.col("k") * _PLACES + F.col("n")
    stored = vectors.select((F.col("node_seq") - (1 << 62)).alias("seq"), F.lit(-1).cast("long").alias("at"), F.col("embedding").alias("vec"), F.col("name").alias("node"), born(F.lit(-1), F.col("node_seq")).alias("node_born"))
    new = names.where("how = 'new' and embedding is not null").select(place.alias("seq"), F.col("k").alias("at"), F.col("embedding").alias("vec"), F.col("name").alias("node"), F.col("born").alias("node_born"))
    every = stored.unionByName(new)
    hits = search(open_.select(place.alias("q"), F.col("k").alias("at"), F.col("embedding").alias("vec")), every.select("seq", "at", "vec"), 1).where(F.col("sim") >= threshold)
    found = hits.join(every.select("seq", "node", "node_born"), "seq")
    return found.select(F.floor(F.col("q") / _PLACES).alias("k"), F.pmod("q", F.lit(_PLACES)).alias("n"), "node", "node_born")


def _names(names: DataFrame, before: DataFrame, firsts: DataFrame, vectors: DataFrame | None, threshold: float, kept: Kept, search: Callable[..., DataFrame]) -> DataFrame:
    found = _look_up(names.withColumn("_low", F.lower("name")), firsts, "_low", 2 * F.col("k")).drop("_low")
    near = None
    if vectors is not None:
        found = kept(found, "found")
        near = _similar(found.where("node is null and embedding is not null").select("k", "n", "embedding"), before, vectors, threshold, search)
        found = found.join(near.select("k", "n", F.col("node").alias("_near"), F.col("node_born").alias("_near_born")), ["k", "n"], "left")
    else:
        found = found.withColumns({"_near": F.lit(None).cast("string"), "_near_born": F.lit(None).cast("struct<k:long,n:long>")})
    how = F.when(F.col("node").isNotNull(), "alias").when(F.col("_near").isNotNull(), "vector").otherwise("new")
    own = {"canonical": F.coalesce("node", "_near", "name"), "born": F.coalesce("node_born", "_near_born", born(F.col("k"), F.col("n"))), "how": how}
    return found.withColumns(own).drop("node", "node_born", "_near", "_near_born")


def _ends(edges: DataFrame, names: DataFrame, bare: DataFrame, entities: DataFrame, firsts: DataFrame) -> DataFrame:
    """(k, n, end, name, known): both ends of each edge, end 0 or 1, by the name of the node that they mean; known: whether there is that node without the document's edges."""
    side = lambda e, c: F.struct(F.lit(e).alias("end"), F.col(c).alias("name"))
    ends = edges.select("k", "n", F.explode(F.array(side(0, "source"), side(1, "target"))).alias("x")).select("k", "n", "x.end", "x.name")
    own = names.select("k", F.col("name").alias("_from"), F.col("canonical").alias("_to"))
    ends = ends.join(own.withColumnRenamed("k", "_k"), (F.col("k") == F.col("_k")) & (F.col("name") == F.col("_from")), "left").withColumn("name", F.coalesce("_to", "name")).drop("_k", "_from", "_to")
    made = entities.select("name", F.lit(-1).cast("long").alias("since")).unionByName(names.where("how = 'new'").select("name", (2 * F.col("k")).alias("since"))).unionByName(bare.select("name", (2 * F.col("k") + 1).alias("since")))
    nodes = made.groupBy("name").agg(F.min("since").alias("since")).withColumnRenamed("name", "_node")
    now = 2 * F.col("k") + 1
    known = lambda df: df.join(nodes, F.col("name") == F.col("_node"), "left").withColumn("known", F.coalesce(F.col("since") < now, F.lit(False))).drop("_node", "since")
    ends = known(ends).withColumn("_both", F.min("known").over(Window.partitionBy("k", "n")))
    ends = _look_up(ends.withColumn("_low", F.lower("name")), firsts, "_low", now)
    ends = ends.withColumn("name", F.when(F.col("_both"), F.col("name")).otherwise(F.coalesce("node", "name")))
    return known(ends.select("k", "n", "end", "name"))


def _bare(ends: DataFrame, names: DataFrame) -> DataFrame:
    """(name, k, n): ends that are no node, where they are first used, numbered after the document's names."""
    firsts = ends.where(~F.col("known") & F.col("name").isNotNull()).groupBy("name").agg(F.min(F.struct("k", "n", "end")).alias("x"))
    sizes = names.groupBy("k").agg(F.count("*").alias("_names"))
    rows = firsts.select("name", "x.k", F.col("x.n").alias("_n"), "x.end").join(sizes, "k", "left")
    place = F.row_number().over(Window.partitionBy("k").orderBy("_n", "end"))
    return rows.select("name", "k", (F.coalesce("_names", F.lit(0)) + place).cast("long").alias("n"))


def _by_holders(now: DataFrame, edges: DataFrame, bare: DataFrame, entities: DataFrame, threshold: float, kept: Kept, search: Callable[..., DataFrame]) -> Resolution:
    """resolve_batch() without vectors and edges: what a round says follows from the holders of keys alone, so when these stay as they are all is right; names are written once, last."""
    firsts, rounds = kept(_first_holders(_holders(entities, now, bare)), "holders"), 0
    while True:
        rounds += 1
        then = _names(now, now, firsts, None, threshold, kept, search)
        after = kept(_first_holders(_holders(entities, then, bare)), "holders")
        if after.exceptAll(firsts).isEmpty() and firsts.exceptAll(after).isEmpty():
            return Resolution(kept(then, "names"), edges, bare, rounds)
        firsts = after


def resolve_batch(names: DataFrame, edges: DataFrame, entities: DataFrame, kept: Kept, vectors: DataFrame | None = None, threshold: float = THRESHOLD, search: Callable[..., DataFrame] = nearest) -> Resolution:
    """``names``: k, n, name, aliases[, embedding], n numbering a document's names from 1; ``edges``: k, n, source, target, ...; ``entities`` and
    ``vectors``: what is stored. ``kept`` writes a table and reads it back. A name without an embedding is resolved by alias only."""
    entities = entities.select("node_seq", "name", "aliases")
    now = names.withColumns({"canonical": F.col("name"), "born": born(F.col("k"), F.col("n")), "how": F.lit("new")})
    bare = names.sparkSession.createDataFrame([], "name string, k long, n long")
    if vectors is None and edges.isEmpty():
        return _by_holders(now, edges, bare, entities, threshold, kept, search)
    rounds = 0
    while True:
        rounds += 1
        firsts = kept(_first_holders(_holders(entities, now, bare)), "holders")
        then = kept(_names(names, now, firsts, vectors, threshold, kept, search), "names")
        after = kept(_first_holders(_holders(entities, then, bare)), "holders")
        ends = kept(_ends(edges, then, bare, entities, after), "ends")
        loose = kept(_bare(ends, then), "bare")
        said = ("k", "n", "canonical", "born", "how")
        same = then.select(*said).exceptAll(now.select(*said)).isEmpty() and loose.exceptAll(bare).isEmpty() and bare.exceptAll(loose).isEmpty()
        now, bare = then, loose
        if same:
            break
    pair = ends.groupBy("k", "n").agg(F.max(F.when(F.col("end") == 0, F.col("name"))).alias("source"), F.max(F.when(F.col("end") == 1, F.col("name"))).alias("target"))
    return Resolution(now, edges.drop("source", "target").join(pair, ["k", "n"]), bare, rounds)
