"""Vector and string similarity."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors of a tile's side.
TILE = 4096


def cosine(a: Column, b: Column) -> Column:
    """dot / (|a| |b|) in doubles, 0 where a norm is 0; the arrays have one size."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot / size)


#: What product() returns.
PAIR = "q long, seq long, sim double"


def product(pdf: pd.DataFrame, k: int, group: bool, timed: bool) -> pd.DataFrame:
    """The k best stored rows (side 1) of a tile for each of its queries (side 0), from columns side, key, grp, at and vec."""
    a, b = pdf[pdf.side == 0], pdf[pdf.side == 1].sort_values("key")
    if a.empty or b.empty:
        return pd.DataFrame({"q": [], "seq": [], "sim": []})

    def unit(rows: pd.DataFrame) -> np.ndarray:
        m = np.stack(rows["vec"].to_numpy())
        n = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    x, y = unit(a), unit(b)
    seq, groups, out = b["key"].to_numpy(), b["grp"].to_numpy(), []
    for at in range(0, len(x), 256):
        sim = np.round(x[at : at + 256] @ y.T, 9)
        if group:
            mine = a["grp"].to_numpy()[at : at + 256]
            named = np.array([bool(g) for g in mine])
            sim[(mine[:, None] == groups[None, :]) & named[:, None]] = -np.inf
        if timed:
            sim[b["at"].to_numpy()[None, :] >= a["at"].to_numpy()[at : at + 256, None]] = -np.inf
        best = np.argsort(-sim, axis=1, kind="stable")[:, :k]  # stable: ties keep the order of seq
        got = np.take_along_axis(sim, best, 1)
        rows, cols = np.nonzero(got > -np.inf)
        out.append(pd.DataFrame({"q": a["key"].to_numpy()[at + rows], "seq": seq[best[rows, cols]], "sim": got[rows, cols]}))
    return pd.concat(out)


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """(q, seq, sim, rank): the k best of the tiles' best."""
    order = Window.partitionBy("q").orderBy(F.desc("sim"), "seq")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def side(df: DataFrame, key: str, number: int, group: bool, timed: bool) -> DataFrame:
    """Rows as product() takes them."""
    of = F.col("grp").cast("string") if group else F.lit(None).cast("string")
    at = F.col("at").cast("long") if timed else F.lit(0).cast("long")
    return df.select(F.lit(number).alias("side"), F.col(key).cast("long").alias("key"), of.alias("grp"), at.alias("at"), F.col("vec").cast("array<double>").alias("vec"), *[c for c in ("cell",) if c in df.columns])


def nearest(queries: DataFrame, stored: DataFrame, k: int, exclude_own_group: bool = False, tile: int = TILE) -> DataFrame:
    """(q, seq, sim, rank): the k stored vectors most similar to each query vector, exactly.

    ``queries``: q, [grp,] [at,] vec; ``stored``: seq, [grp,] [at,] vec. Both sides are dealt to blocks of about ``tile`` rows and each pair of
    blocks is one matrix product, whose k best a query are all that leaves it: no pair of rows is ever a row. With
    ``exclude_own_group`` a vector of the query's own group cannot be a hit (nothing is excluded for a null or empty group). Where both sides
    have ``at``, a number, only vectors of a smaller one than the query's can be.
    Ties go to the smaller seq; similarities are compared at nine decimals; vectors of zero length have similarity 0.
    """
    counts = [max(1, -(-df.count() // tile)) for df in (queries, stored)]
    group = "grp" in queries.columns and exclude_own_group
    timed = "at" in queries.columns and "at" in stored.columns

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    left = side(queries.drop("cell"), "q", 0, group, timed).withColumn("i", own(counts[0])).withColumn("j", every(counts[1]))
    right = side(stored.drop("cell"), "seq", 1, group, timed).withColumn("j", own(counts[1])).withColumn("i", every(counts[0]))

    columns = ("side", "key", "grp", "at", "vec", "i", "j")
    parts = left.select(*columns).unionByName(right.select(*columns)).groupBy("i", "j").applyInPandas(lambda pdf: product(pdf, k, group, timed), PAIR)
    return ranked(parts, k)


def unit_dot(a: Column, b: Column) -> Column:
    """Cosine of vectors that already have length 1."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


@F.pandas_udf(T.DoubleType())
def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp similarity of (a, b); it depends on their order."""
    for a, b in batches:
        yield pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


def may_reach(a: Column, b: Column, least: float) -> Column:
    """Whether lengths alone allow a ratio above ``least``: what shortens the list before ratio()."""
    return 2 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b)) > least
