"""Exact top-k search by inner product over an impact-ordered index, score at a time.

The stored vectors are dealt to blocks of about BLOCK rows and the queries to batches; a (batch, block) cell is the unit of
work. A block is indexed by its components: a posting segment is a dimension with the rows whose component lies in one narrow range, and
its impact on a query is the largest product that the range allows. For a few queries at a time the segments are processed by descending
impact, each adding its quantised impact (rounded up) to the accumulators of its rows. At some points on the way every accumulator, with the
largest impact that is still open in each dimension that its row has not been met in, bounds a score from above. Once few bounds
reach a score that k + 1 rows are known to have, no row outside those few can be among the best: they are scored exactly and
processing stops. If that never happens, all segments are processed, and the same test decides what is scored. Nothing is ever
dropped without that proof, so results are exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .vectors import usable, whole

TOP = 5
#: Rows of a block and of a batch of queries: what one task holds of either.
BLOCK, BATCH = 8192, 8192
#: Queries whose accumulators are held at a time, and posting segments of a dimension.
ABREAST, LEVELS = 256, 64
#: Shares of the postings after which bounds are looked at, and the share of (row, query) pairs that is few enough to be scored.
LOOKS, FEW = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0), 0.125
#: Rows scored at first for a score to beat; pairs scored at a time.
FIRST, PAIRS = 1024, 1 << 16
#: Quantised impacts of a row add up to this at most.
_MOST = 30_000


class Index:
    """The posting segments of a block (n rows of d whole numbers)."""

    def __init__(self, rows: np.ndarray):
        self.rows, (self.n, self.d) = rows, rows.shape
        self.size = np.abs(rows).max(axis=0, initial=0)
        parts: list[tuple[int, int, np.ndarray]] = []
        dims: list[int] = []
        for i in range(self.d):
            column = rows[:, i]
            low, high = int(column.min()), int(column.max())
            width = -(-(high - low + 1) // LEVELS)
            level = (column - low) // width
            order = np.argsort(level, kind="stable").astype(np.int32)
            cuts = np.flatnonzero(np.diff(level[order])) + 1
            for a, b in zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [self.n])).tolist(), strict=True):
                held = column[order[a:b]]
                parts.append((int(held.min()), int(held.max()), order[a:b]))
                dims.append(i)
        self.dim = np.array(dims, np.int64)
        self.low, self.high = np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)
        self.postings = [p[2] for p in parts]
        self.count = np.array([len(p) for p in self.postings], np.int64)
        self.first = np.searchsorted(self.dim, np.arange(self.d))

    def possible(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(row, query) pairs that may be among a query's k + 1 best, all others being proved not to be, and the postings processed."""
        m = len(queries)
        beat, best = self._to_beat(queries, k), np.zeros(0)
        # impacts in units of each query's own, so that a row's sum fits sixteen bits
        unit = np.maximum(1, -(-(np.abs(queries) @ self.size) // _MOST))
        weight = queries.T[self.dim]
        impact = -((-np.maximum(weight * self.low[:, None], weight * self.high[:, None])) // unit)
        order = np.argsort(-np.abs(impact).max(axis=1), kind="stable")
        done = np.cumsum(self.count[order])
        kind = np.int16 if self.d <= 2000 else np.int32  # rounding up adds 1 a dimension at most
        small = impact.astype(kind)
        sums, seen = np.zeros((self.n, m), kind), np.zeros((self.n, self.d), np.float32)
        open_, at = impact.copy(), 0
        for look in LOOKS:
            to = len(order) if look == 1.0 else max(at, int(np.searchsorted(done, look * done[-1])))
            for s in order[at:to].tolist():
                sums[self.postings[s]] += small[s]
                seen[self.postings[s], self.dim[s]] = 1
            open_[order[at:to]] = np.iinfo(np.int64).min
            at = to
            left = np.maximum.reduceat(open_, self.first, axis=0)
            left[left == np.iinfo(np.int64).min] = 0  # every row was met there
            # in floats these whole numbers are exact: they are below 2^24
            best = sums + ((1 - seen) @ left.astype(np.float32))
            reach = best >= np.ceil(beat / unit)
            if np.count_nonzero(reach) <= FEW * reach.size:
                break
        row, query = np.nonzero(reach)
        # those with the highest bounds first: what they score is to be beaten by the others
        bound = best[row, query]
        high = np.full(m, np.inf)
        by = np.lexsort((-bound, query))
        starts = np.searchsorted(query[by], np.arange(m + 1))
        for q, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
            head = by[a : min(b, a + 4 * (k + 1))]
            if len(head) > k:
                high[q] = np.sort(self.scores(row[head], queries[q : q + 1], np.zeros(len(head), np.int64)))[-k - 1]
        beat = np.where(np.isinf(high), beat, np.maximum(beat, high))
        keep = bound >= np.ceil(beat / unit)[query]
        return row[keep], query[keep], int(done[at - 1]) if at else 0

    def _to_beat(self, queries: np.ndarray, k: int) -> np.ndarray:
        """For each query a score that k + 1 rows reach."""
        some = self.rows[:FIRST]
        if len(some) <= k:
            return np.full(len(queries), -np.inf)
        return np.partition(some @ queries.T, -k - 1, axis=0)[-k - 1].astype(np.float64)

    def scores(self, row: np.ndarray, queries: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact scores of pairs."""
        out = np.empty(len(row), np.int64)
        for a in range(0, len(row), PAIRS):
            b = a + PAIRS
            np.einsum("ij,ij->i", self.rows[row[a:b]], queries[query[a:b]], out=out[a:b])
        return out


def _stack(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; what a shorter one lacks is 0."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def cell(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k + 1 best rows of a block for each query of a batch: (q, vec_id, score), a query's own row being one like others."""
    pdf = pdf.sort_values(["side", "none", "key"], kind="stable")  # ties go to the smaller id, so rows stand in its order
    stored, asked = pdf[pdf["side"] == 1], pdf[pdf["side"] == 0]
    if stored.empty or asked.empty:
        return pd.DataFrame({"q": [], "vec_id": [], "score": []}).astype({"q": "int64", "vec_id": "Int64", "score": "int64"})
    width = max(1, int(pdf["x"].map(len).max()))
    rows, queries = _stack(stored["x"], width), _stack(asked["x"], width)
    largest = int(np.abs(rows).max()) * int(np.abs(queries).max()) * width
    if largest >= 1 << 50:
        raise OverflowError("components are too large: scores must stay below 2^50")
    ids = pd.Series(stored["key"].to_numpy(np.int64), dtype="Int64").mask(stored["none"].to_numpy(bool)).array
    index, keys, out = Index(rows), asked["key"].to_numpy(np.int64), []
    for a in range(0, len(queries), ABREAST):
        part = queries[a : a + ABREAST]
        row, query, _ = index.possible(part, k)
        score = index.scores(row, part, query)
        by = np.lexsort((row, -score, query))
        place = np.arange(len(by)) - np.searchsorted(query[by], query[by])
        by = by[place <= k]
        out.append(pd.DataFrame({"q": keys[a + query[by]], "vec_id": ids[row[by]], "score": score[by]}))
    return pd.concat(out)


def _blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def topk_search(df: DataFrame, k: int = TOP, asks: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``df`` (vec_id, embedding) that ``asks`` is true of, by default those whose vec_id is
    divisible by 50, the ``k`` other rows of the highest inner product of vectors.whole(). Other columns are ignored, whatever their names.

    Ties go to the smaller vec_id, rows without one last. Vectors that are null or hold null or non-finite components neither ask nor answer. A
    vec_id that stands in several rows asks once for each, and each of them is an answer to the others; rows that are equal have
    equal results. A vector that is shorter than another one counts as 0 where it ends. With fewer than ``k`` other rows all are
    returned; an empty table has no rows. Scores must stay below 2^50, else OverflowError is raised.
    """
    spark = df.sparkSession
    rows = usable(df.select("vec_id", "embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding")).alias("x"))
    asked = rows.where(F.col("vec_id") % 50 == 0 if asks is None else asks)
    # equal rows ask together; a number of their own tells queries apart, so it is written down
    asked = scratch.save(asked.groupBy("vec_id", "x").agg(F.count("*").alias("copies")).withColumn("q", F.monotonically_increasing_id()), "topk-queries")
    i, j = _blocks(asked.count(), BATCH), _blocks(rows.count(), block)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    number = F.monotonically_increasing_id()
    key = F.coalesce("vec_id", F.lit(0).cast("long"))  # a column of numbers without nulls stays one in pandas
    stored = rows.select(F.lit(1).alias("side"), F.col("vec_id").isNull().alias("none"), key.alias("key"), "x", F.pmod(number, F.lit(j)).cast("int").alias("j")).withColumn("i", spread(i))
    asking = asked.select(F.lit(0).alias("side"), F.lit(False).alias("none"), F.col("q").alias("key"), "x", F.pmod(F.xxhash64("q"), F.lit(i)).cast("int").alias("i")).withColumn("j", spread(j))
    cells = stored.unionByName(asking).groupBy("i", "j").applyInPandas(lambda pdf: cell(pdf, k), "q long, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    best = cells.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    told = best.join(asked.select("q", F.col("vec_id").alias("query_id"), "copies", F.aggregate("x", F.lit(0).cast("long"), lambda s, c: s + c * c).alias("_own")), "q")
    # one row of the query's id and of its score with itself is the query's own, wherever it is among equal ones
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("_own"))
    first = F.min(F.when(own, F.col("_n"))).over(Window.partitionBy("q"))
    told = told.withColumn("_at", first).where(F.col("_at").isNull() | (F.col("_n") != F.col("_at")))
    told = told.withColumn("rank", (F.col("_n") - F.when(F.col("_n") > F.col("_at"), 1).otherwise(0)).cast("int")).where(F.col("rank") <= k)
    return told.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")).drop("_copy")
