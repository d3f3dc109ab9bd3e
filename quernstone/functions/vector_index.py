"""An inverted file of vectors: cells around centroids, of which a query probes the nearest.

Centroids come from a bounded sample, by k-means on unit vectors; so does the number of cells that a query probes, the smallest with
which queries of the sample find the wanted share of their nearest neighbours. After that each vector stands in one cell, new vectors as they come, and
a search is an equi-join on cells: a query meets the vectors of the cells it probes, exactly compared, in tiles as nearest() makes
them, so a cell that holds a third of all vectors is dealt to many tasks. Vectors without a cell (stored before there was an index) are met by all queries.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .similarity import PAIR, TILE, product, ranked, side

#: Vectors that centroids are drawn from, queries of them that the number of probes is drawn from, and rounds of k-means.
SAMPLE, QUERIES, ROUNDS = 16_384, 512, 12
#: The share of the nearest neighbours to be found, and how many neighbours count.
RECALL, NEIGHBOURS = 0.95, 10
#: Cells at most: what is sent to every task is so many vectors.
CELLS = 1024
#: The cell of vectors without one.
LOOSE = -1


@dataclass(frozen=True)
class Cells:
    centroids: np.ndarray
    probes: int


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def fit(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, recall: float = RECALL, k: int = NEIGHBOURS, rows: int | None = None) -> Cells | None:
    """Cells for ``vectors`` (seq, vec); by default about the root of their number of them. None where there are too few vectors to have cells."""
    rows = vectors.count() if rows is None else rows
    drawn = vectors.select("seq", "vec").where("vec is not null and size(vec) > 0").orderBy(F.xxhash64("seq"), "seq").limit(sample).collect()  # a bounded sample, the same each time
    sizes = Counter(len(r["vec"]) for r in drawn).most_common(1)  # vectors of another size get no cell
    x = _unit(np.array([r["vec"] for r in drawn if len(r["vec"]) == sizes[0][0]], float)) if drawn else np.zeros((0, 0))
    cells = min(CELLS, len(x) // 8, cells or max(1, round(rows**0.5)))
    if cells < 2:
        return None
    rng = np.random.default_rng(0)
    centre = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(ROUNDS):
        own = (x @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        some = np.bincount(own, minlength=cells) > 0
        centre = np.where(some[:, None], _unit(sums), centre)
    own = (x @ centre.T).argmax(axis=1)
    asked = rng.choice(len(x), min(QUERIES, len(x)), replace=False)
    sims = x[asked] @ x.T
    sims[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-sims, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(x[asked] @ centre.T), axis=1), axis=1)  # of each cell among a query's
    at = np.take_along_axis(place, own[near], 1)
    found = [(at < p).mean() for p in range(1, cells + 1)]
    return Cells(centre, next(p for p, share in enumerate(found, 1) if share >= recall))


def _cells(vec: Column, cells: Cells, n: int) -> Column:
    """The n nearest cells of each vector; null for a null or empty vector or one of another size."""
    centre = cells.centroids

    @F.pandas_udf("array<int>")
    def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            out = pd.Series([None] * len(part), index=part.index, dtype=object)
            good = part.map(lambda v: v is not None and len(v) == centre.shape[1])
            if good.any():
                sims = _unit(np.stack(part[good].to_numpy())) @ centre.T
                best = np.argsort(-sims, axis=1, kind="stable")[:, :n].astype(np.int32)
                out[good] = pd.Series(list(best), index=part.index[good], dtype=object)
            yield out

    return near(vec)


def in_cells(vectors: DataFrame, cells: Cells | None, vec: str = "vec") -> DataFrame:
    """``vectors`` with ``cell``, null where there are no cells."""
    cell = F.lit(None).cast("int") if cells is None else F.get(_cells(F.col(vec).cast("array<double>"), cells, 1), F.lit(0))
    return vectors.withColumn("cell", cell)


def search(queries: DataFrame, stored: DataFrame, cells: Cells, k: int, exclude_own_group: bool = False, tile: int = TILE) -> DataFrame:
    """As nearest(), among the vectors of the cells that a query probes: (q, seq, sim, rank). ``stored`` has ``cell``."""
    group, timed = "grp" in queries.columns and exclude_own_group, "at" in queries.columns and "at" in stored.columns
    probed = F.explode(F.concat(F.array(F.lit(LOOSE)), F.coalesce(_cells(F.col("vec").cast("array<double>"), cells, cells.probes), F.array().cast("array<int>"))))
    left = side(queries.withColumn("cell", probed), "q", 0, group, timed)
    right = side(stored.withColumn("cell", F.coalesce("cell", F.lit(LOOSE))), "seq", 1, group, timed)
    # how many tiles each side of a cell makes: a row for each cell
    counts = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias(name))
    tiles = counts(left, "_q").join(counts(right, "_s"), "cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    left = left.join(tiles, "cell").withColumn("i", own("_q")).withColumn("j", every("_s"))
    right = right.join(tiles, "cell").withColumn("j", own("_s")).withColumn("i", every("_q"))
    columns = ("side", "key", "grp", "at", "vec", "cell", "i", "j")
    parts = left.select(*columns).unionByName(right.select(*columns)).groupBy("cell", "i", "j").applyInPandas(lambda pdf: product(pdf, k, group, timed), PAIR)
    return ranked(parts, k)
