"""Exact copies by distributed MSD radix partitioning.

Texts are split by their length and their first bytes, then each group by the next bytes, and so on with longer
stretches, until a group has one member or its texts have ended. Equality is that of the bytes; no digest decides. A round
counts a group's next stretches by a partial aggregate and hands the counts back by a sort-merge join (the same at every
size) that Spark can split where one group is large; a text leaves as soon as it is alone, so later rounds only carry copies. The stretches grow by a factor, so
rounds grow with the logarithm of the longest text.

Defined cases: a null text equals an empty one; of equal texts the smallest doc_id stays, and all rows that have it are
kept; rows with a null doc_id take part, and stay only where no equal text has one; an empty table gives no rows; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: str = "text") -> Column:
    """One space for each run of white space, as bytes."""
    return F.encode(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " "), "UTF-8")


def exact_dedup(docs: DataFrame, first: int = 64, factor: int = 16, owner: str = "query") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    texts = docs.select("doc_id", normalised().alias("rest"))
    at = ["size", "stretch"]
    keyed = texts.withColumns({"size": F.octet_length("rest"), "stretch": F.substring("rest", 1, first)})
    groups = keyed.groupBy(*at).agg(F.count("*").alias("n"), F.min("doc_id").alias("low")).where("n > 1")
    groups = scratch.save(groups.withColumn("g", F.monotonically_increasing_id()), "groups", owner)
    done = F.coalesce(F.col("n"), F.lit(1)).alias("group_size"), F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("keep_id")

    def step(rows: DataFrame, groups: DataFrame, keys: list[str], offset: int, width: int) -> DataFrame:
        """Rows with the group of their stretch; ``g`` stays null where they are through."""
        ended = F.col("n").isNull() | (F.col("size") <= offset + width)
        go = ~ended
        return rows.join(groups.hint("merge"), keys, "left").select("doc_id", "size", "text_sha256", *done, F.when(go, F.col("g")).alias("g"), F.when(go, F.expr(f"substring(rest, {width + 1})")).alias("rest"))

    width, offset = first, 0
    table = scratch.save(step(keyed.withColumn("text_sha256", F.sha2("rest", 256)), groups, at, 0, width), "round", owner)
    finals = [table.where("g is null")]
    while not (active := table.where("g is not null")).isEmpty():
        offset, width = offset + width, width * factor
        cut = active.select("doc_id", "size", "text_sha256", "rest", F.col("g").alias("of"), F.substring("rest", 1, width).alias("stretch"))
        groups = cut.groupBy("of", "stretch").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")).where("n > 1")
        groups = scratch.save(groups.withColumn("g", F.monotonically_increasing_id()), "groups", owner)
        table = scratch.save(step(cut, groups, ["of", "stretch"], offset, width), "round", owner)
        finals.append(table.where("g is null"))
    out = reduce(DataFrame.unionByName, finals)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
