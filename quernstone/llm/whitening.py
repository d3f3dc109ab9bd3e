"""Whitening of embeddings: covariance by one aggregation over the upper triangle, components by LAPACK.

Vectors become whole numbers (vectors.whole), so every sum here is exact and no result depends on the order in which tasks end. A
first aggregation over the distinct vectors gives their number and each dimension's sum; a second one has the sum for each pair of dimensions, by
generated SQL expressions: the products of both components after their dimension's mean, rounded to a whole number, was taken off. What rounding left is
taken off the covariance in whole numbers too. Sums are kept in 64 bits where the largest component and the number of rows
show that they fit, else in decimals. Only one number a pair of dimensions reaches the driver, whatever the number of rows.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .vectors import usable, whole

COMPONENTS = 4
#: Expressions of one aggregation, so that Spark compiles it: vectors of up to so many dimensions need one; of more, the table is aggregated once for each so many.
COLUMNS = 64
#: An eigenvalue below this share of the largest one is taken for zero.
ZERO = 1e-12
_LONG = 1 << 62


def _narrow(size: int) -> str:
    """The smallest type of whole numbers that holds ``size`` and its opposite."""
    return next(kind for kind, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if size < 1 << bits)


def _sum(term: str, most: int) -> str:
    """SQL for an exact sum of ``term``, which stays below ``most`` in all."""
    return f"sum({term})" if most < _LONG else f"sum(cast({term} as decimal(38, 0)))"


def _wide(term: str, most: int) -> str:
    return term if most < _LONG else f"cast({term} as decimal(19, 0))"


def upper_triangle(dims: int, wide: bool) -> list[str]:
    """SQL expressions over rows (c, i, v), one for each dimension of each centred vector c, v being its i-th entry: in group i, p_j is the sum of c_i * c_j for each j >= i."""
    term = "cast(v as decimal(19, 0)) * cast(c[{0}] as decimal(19, 0))" if wide else "v * c[{0}]"
    return [f"sum({term.format(j)}) filter (where i <= {j}) as p_{j}" for j in range(dims)]


def covariance(fit: DataFrame, n: int, sums: list[int], size: int) -> np.ndarray:
    """The covariance matrix (divisor ``n``) of column x of ``fit``, each entry exact before it is rounded to a double. ``size``: the largest absolute entry of x.

    One expression for each pair in one flat aggregation would be thousands of them, which Spark then runs uncompiled (at 64 dimensions
    13 times the CPU time). So a vector has a row for each of its dimensions, and the pair (i, j) is expression j in group i: all pairs are still one aggregation.
    """
    d = len(sums)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    most = size + max(map(abs, centre), default=0)
    rows = fit.selectExpr(f"array({', '.join(f'cast(x[{i}] as bigint) - {c}' for i, c in enumerate(centre))}) as c").selectExpr("c", "posexplode(c) as (i, v)")
    asked, got = upper_triangle(d, most * most * n >= _LONG), {}
    for at in range(0, d, COLUMNS):
        for row in rows.groupBy("i").agg(*map(F.expr, asked[at : at + COLUMNS])).collect():  # one row a dimension
            got |= {(row["i"], j): row[f"p_{j}"] for j in range(max(at, row["i"]), min(d, at + COLUMNS))}
    left = [s - n * c for s, c in zip(sums, centre, strict=True)]
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            out[i, j] = out[j, i] = float(Fraction(n * int(got[i, j]) - left[i] * left[j], n * n))
    return out


def principal(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` eigenvalues, falling, and their unit eigenvectors as rows, each with its largest entry positive. Values that are zero but for rounding are 0."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k].T.copy()
    for row in vectors:
        row *= 1.0 if row[np.abs(row).argmax()] >= 0 else -1.0
    return np.where(values > ZERO * max(values.max(initial=0.0), 0.0), values, 0.0), vectors


def _project(means: np.ndarray, vector: np.ndarray, value: float) -> Column:
    """The centred vector x on ``vector``, over the root of ``value``; null where that is 0."""
    if not value > 0:
        return F.lit(None).cast("double")
    terms = [f"(x[{i}] - {float(m)!r}D) * {float(w)!r}D" for i, (m, w) in enumerate(zip(means, vector, strict=True))]
    return F.expr(" + ".join(terms)) / F.lit(float(np.sqrt(value)))


def whitening(df: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): for each row of ``df`` (vec_id, embedding) and each of the first ``k``
    principal components of the distinct whole vectors, the row's coordinate after whitening. Other columns are ignored, whatever their names.

    n: distinct vectors; deviation: the sum over dimensions of (n * x - S)^2, exact; explained: the component's share of the variance;
    identity_error: how far the covariance of the whitened distinct vectors is from the identity, one value for all rows.

    Rows whose vector is null or holds null or non-finite components are left out; rows with equal vectors or ids stay. Of vectors of several
    lengths those of the most frequent one (of equally frequent ones the longest) take part. There are no more components than dimensions, so
    empty vectors give no rows, nor does an empty table. A component without variance (all vectors equal, or fewer distinct vectors than
    components) has whitened null and explained 0 (null if there is no variance at all), and is left out of identity_error, which is 0 where no component has variance. A
    deviation beyond 64 bits is an error, not a wrong number.
    """
    columns = "vec_id {0}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark, kind = df.sparkSession, df.schema["vec_id"].dataType.simpleString()
    rows = usable(df.select("vec_id", "embedding")).select("vec_id", whole(F.col("embedding")).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c"), F.max(F.array_max("x")).alias("high"), F.min(F.array_min("x")).alias("low"))
    common = sizes.orderBy(F.desc("c"), F.desc("d")).first()
    if common is None or common["d"] == 0:
        return spark.createDataFrame([], columns.format(kind))
    d, size = common["d"], max(abs(common["high"]), abs(common["low"]))
    rows = rows.where(F.size("x") == d).select("vec_id", F.col("x").cast(f"array<{_narrow(size)}>").alias("x"))
    fit = scratch.save(rows.select("x").distinct(), "whitening-fit")
    told = fit.selectExpr("count(*) as n", *[f"{_sum(f'cast(x[{i}] as bigint)', size * common['c'])} as s_{i}" for i in range(d)]).first()
    n, sums = told["n"], [int(told[f"s_{i}"]) for i in range(d)]
    v = covariance(fit, n, sums, size)
    means, trace = np.array([float(Fraction(s, n)) for s in sums]), float(np.trace(v))
    values, vectors = principal(v, min(k, d))
    whitened = [_project(means, w, e) for e, w in zip(values, vectors, strict=True)]
    error = _identity_error(fit, [w for w, e in zip(whitened, values, strict=True) if e > 0], n)
    most = 4 * d * (n * size) ** 2
    off = [_wide(f"({_wide(f'cast(x[{i}] as bigint)', most)} * {n} - {s})", most) if most < _LONG else f"cast(cast(x[{i}] as decimal(19, 0)) * {n} - {s} as decimal(19, 0))" for i, s in enumerate(sums)]
    deviation = F.expr(f"cast({' + '.join(f'{x} * {x}' for x in off)} as bigint)")
    each = [F.struct(F.lit(c).alias("component"), w.alias("whitened"), F.lit(float(e) / trace if trace > 0 else None).cast("double").alias("explained")) for c, (w, e) in enumerate(zip(whitened, values, strict=True), 1)]
    out = rows.select("vec_id", F.lit(n).cast("long").alias("n"), deviation.alias("deviation"), F.explode(F.array(*each)).alias("c"))
    return out.select("vec_id", "c.component", "n", "deviation", "c.whitened", "c.explained", F.lit(error).alias("identity_error"))


def _identity_error(fit: DataFrame, whitened: list[Column], n: int) -> float:
    """The largest absolute entry of the covariance of ``whitened`` over ``fit`` minus the identity, its means taken off before anything is multiplied."""
    if not whitened:
        return 0.0
    k = len(whitened)
    rows = fit.select(*[w.alias(f"w_{a}") for a, w in enumerate(whitened)])
    mean = rows.agg(*[F.avg(f"w_{a}").alias(f"m_{a}") for a in range(k)]).first()
    off = [F.col(f"w_{a}") - F.lit(mean[f"m_{a}"]) for a in range(k)]
    got = rows.agg(*[F.sum(off[a] * off[b]).alias(f"p_{a}_{b}") for a in range(k) for b in range(a, k)]).first()
    return max(abs(got[f"p_{a}_{b}"] / n - (a == b)) for a in range(k) for b in range(a, k))
