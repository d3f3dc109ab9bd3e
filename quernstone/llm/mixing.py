"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words; each document of it gets expected copies, the more the higher its odds, at most
``most``. Whole copies are certain. For the rest, a document's rank is its random odds u / (1 - u) over its inclusion odds
p / (1 - p), and the lowest ranks are taken until the source's words are used up: a sample of fixed size (in words) with
unequal probabilities. u is a hash of doc_id, so reruns agree.

Ranks are never sorted by source. Words are summed by 2^10 slices of the rank, then by 2^10 slices of the one slice that the
budget ends in, and only the rows of that last slice are ordered; a source that holds a third of all rows is as cheap as any. What
the next rank would overshoot, one document of the nearest size closes.

Defined cases: a null or blank text has size 0 and is never taken; null is a source of its own, the last one; rows that repeat
a doc_id draw the same u and are decided one by one; a null doc_id draws one too; an empty table gives no rows; other columns
are carried by rows() and not read by decide().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

WORD = r"[^\x20\x09-\x0D]+"
SLICES = 1 << 10


def words(text: str = "text") -> Column:
    """Number of words; null counts none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def level(table: DataFrame, by: list[str], cap: str, weight: str, total: Column) -> DataFrame:
    """Adds ``level``: the share of a unit of weight that makes sum(min(cap, level * weight)) the total.

    Rows fill up in the order of cap / weight; before each one, what is left is shared by the weights left.
    """
    order = Window.partitionBy(*by).orderBy(F.col(cap) / F.col(weight))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    share = (total - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (F.sum(weight).over(every) - F.coalesce(F.sum(weight).over(before), F.lit(0)))
    table = table.withColumn("_share", share)
    fits = F.when(F.col("_share") * F.col(weight) <= F.col(cap) * (1 + 1e-12), F.col("_share"))
    return table.withColumn("level", F.coalesce(F.max(fits).over(every), F.lit(float("inf")))).drop("_share")


def decide(docs: DataFrame, size: Column, source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, tilt: float = -0.25, seed: int = 9, owner: str = "query") -> DataFrame:
    """The rows of ``docs`` (with columns ``key`` and ``source``) plus _size, _source_size, _target and _copies.

    ``tilt``: expected copies go with the document's size to this power; 0 treats all alike.
    """
    rank = Window.orderBy(F.col(source).asc_nulls_last())
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    sized = docs.withColumns({"_size": size, "_u": unit}).withColumn("_bin", F.when(F.col("_size") > 0, F.floor(F.log2("_size") * 4).cast("int")))
    small = scratch.save(sized.select(F.col(source).alias("_s"), F.col(key).alias("_key"), "_bin", "_size", "_u"), "sizes", owner)
    bins = scratch.save(small.groupBy("_s", "_bin").agg(F.sum("_size").alias("words")), "bins", owner)
    # one row a source; targets need all of them
    sources = bins.groupBy("_s").agg(F.sum("words").alias("_source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("_s").asc_nulls_last())) - 1
    sources = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, map(float, weights))), (nth % len(weights) + 1).cast("int")))
    full = F.sum("_source_size").over(Window.partitionBy(F.lit(0)))
    sources = level(sources.withColumns({"_cap": F.col("_source_size") * float(most), "_all": F.lit(0), "_total": full}), ["_all"], "_cap", "_w", F.col("_total") * share)
    sources = sources.select("_s", "_source_size", F.least("_cap", F.col("level") * F.col("_w")).alias("_target"))
    # expected copies of each class of sizes
    classes = bins.where("_bin is not null").join(sources.withColumnRenamed("_s", "_z"), F.col("_s").eqNullSafe(F.col("_z"))).drop("_z")
    classes = classes.withColumns({"_v": F.pow(F.lit(2.0), F.col("_bin") / 4 * tilt), "_most": F.col("words") * float(most)})
    classes = level(classes.withColumn("_share_w", F.col("_v") * F.col("words")), ["_s"], "_most", "_share_w", F.col("_target"))
    copies = F.least(F.lit(float(most)), F.col("level") * F.col("_v"))
    classes = classes.withColumn("_whole", F.floor(copies + 1e-9).cast("int")).withColumn("_p", F.greatest(F.lit(0.0), copies - F.col("_whole")))
    classes = scratch.save(classes.select(F.col("_s").alias("_cs"), F.col("_bin").alias("_cb"), "words", "_source_size", "_target", "_whole", "_p"), "classes", owner)
    budget = classes.groupBy(F.col("_cs").alias("_bs")).agg((F.first("_target") - F.sum(F.col("words") * F.col("_whole"))).alias("_left"))

    odds = F.col("_u") / (1 - F.col("_u")) * ((1 - F.col("_p")) / F.col("_p"))
    rank = F.when(F.col("_p") > 1e-9, odds / (1 + odds))

    def ranked(rows: DataFrame) -> DataFrame:
        out = rows.join(classes, F.col("_s").eqNullSafe(F.col("_cs")) & (F.col("_bin") == F.col("_cb")), "left").withColumn("_rank", rank)
        return out.withColumns({"_a": F.floor(F.col("_rank") * SLICES).cast("int"), "_b": F.floor(F.col("_rank") * SLICES * SLICES).cast("int")})

    def end(slices: DataFrame, part: str, left: DataFrame) -> DataFrame:
        """Of each source the slice in which its budget ends, and what is left for that slice."""
        upto = F.sum("_size").over(Window.partitionBy("_s").orderBy(part))
        got = slices.join(left, F.col("_s").eqNullSafe(F.col("_bs"))).withColumn("_upto", upto)
        last = got.where("_upto > _left").groupBy("_s").agg(F.min_by(F.struct(F.col(part).alias("x"), (F.col("_left") - F.col("_upto") + F.col("_size")).alias("y")), part).alias("e"))
        return last.select(F.col("_s").alias("_bs"), F.col("e.x").alias(part + "_end"), F.col("e.y").alias("_left"))

    drawn = ranked(small).where("_rank is not null")
    first = scratch.save(end(drawn.groupBy("_s", "_a").agg(F.sum("_size").alias("_size")), "_a", budget), "first", owner)
    inner = drawn.join(first.withColumnRenamed("_bs", "_f"), F.col("_s").eqNullSafe(F.col("_f")) & (F.col("_a") == F.col("_a_end"))).groupBy("_s", "_b").agg(F.sum("_size").alias("_size"))
    second = end(inner, "_b", first.select("_bs", "_left"))
    ends = scratch.save(first.select(F.col("_bs").alias("_es"), "_a_end").join(second, F.col("_es").eqNullSafe(F.col("_bs")), "left").select("_es", "_a_end", "_b_end", "_left"), "ends", owner)

    def placed(rows: DataFrame) -> DataFrame:
        """_at: 1 where a row's slice lies within the budget, 0 beyond, 2 in the slice where it ends."""
        got = ranked(rows).join(ends, F.col("_s").eqNullSafe(F.col("_es")), "left")
        return got.withColumn("_at", F.when(F.col("_rank").isNull(), 0).when(F.col("_a_end").isNull() | (F.col("_a") < F.col("_a_end")), 1).when(F.col("_a") > F.col("_a_end"), 0).when(F.col("_b_end").isNull() | (F.col("_b") < F.col("_b_end")), 1).when(F.col("_b") > F.col("_b_end"), 0).otherwise(2))

    # the slice that the budget ends in, row by row
    light = placed(small)
    upto = F.sum("_size").over(Window.partitionBy("_s", "_b").orderBy("_rank", "_key", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = scratch.save(light.where("_at = 2").select("_s", "_b", "_rank", "_key", "_size", "_left").withColumn("_in", upto <= F.col("_left")), "last", owner)
    rest = last.groupBy(F.col("_s").alias("_rs")).agg((F.first("_left") - F.coalesce(F.sum(F.when(F.col("_in"), F.col("_size"))), F.lit(0))).alias("_rest"))
    rest = scratch.save(rest, "rest", owner)
    # one more document closes most of the gap that is left: the one whose size is nearest to it
    fits = last.where("_in").select("_s", "_rank", "_key", "_size")
    free = light.where("_at <> 1 and _rank is not null").join(fits.select(*[F.col(c).alias("_x" + c) for c in fits.columns]), F.col("_s").eqNullSafe(F.col("_x_s")) & (F.col("_rank") == F.col("_x_rank")) & F.col("_key").eqNullSafe(F.col("_x_key")) & (F.col("_size") == F.col("_x_size")), "left_anti")
    free = free.join(rest, F.col("_s").eqNullSafe(F.col("_rs"))).where("_size < 2 * _rest")
    one = free.groupBy("_s").agg(F.min(F.struct(F.abs(F.col("_size") - F.col("_rest")).alias("gap"), "_rank", "_key", "_size")).alias("o")).select("_s", "o._rank", "o._key", "o._size")
    fits = scratch.save(fits.unionByName(one).distinct().select(F.col("_s").alias("_ls"), F.col("_rank").alias("_lr"), F.col("_key").alias("_lk"), F.col("_size").alias("_lz"), F.lit(1).alias("_ln")), "taken", owner)
    rows = placed(sized.withColumn("_s", F.col(source)))
    rows = rows.join(fits, (F.col("_at") != 1) & F.col("_s").eqNullSafe(F.col("_ls")) & (F.col("_rank") == F.col("_lr")) & F.col(key).eqNullSafe(F.col("_lk")) & (F.col("_size") == F.col("_lz")), "left")
    # equal rows at the very end are taken together
    taken = F.when(F.col("_at") == 1, 1).otherwise(F.coalesce("_ln", F.lit(0)))
    rows = rows.withColumn("_copies", F.coalesce(F.col("_whole"), F.lit(0)) + taken)
    names = [c for c in docs.columns if c not in ("_source_size", "_target")]
    per = sources.select(F.col("_s").alias("_ts"), F.col("_source_size").alias("_tz"), F.col("_target").alias("_tt"))
    per = scratch.save(per, "targets", owner)
    rows = rows.drop("_source_size", "_target").join(per, F.col("_s").eqNullSafe(F.col("_ts")), "left")
    return rows.select(*names, "_size", F.col("_tz").alias("_source_size"), F.col("_tt").cast("double").alias("_target"), "_copies")


def mix(docs: DataFrame, owner: str = "query", **how) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    held = scratch.save(docs.select("doc_id", "source", words().alias("_n")), "words", owner)
    got = decide(held, F.col("_n"), owner=owner, **how)
    return got.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def rows(docs: DataFrame, owner: str = "query", **how) -> DataFrame:
    """The mix itself: every row as often as it is taken, with its columns."""
    held = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_src"))
    got = decide(held, words("_row.text"), "_src", "_id", owner=owner, **how).where("_copies > 0")
    return got.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
