"""Repeated runs of lines by content-defined line chunks, in DataFrame functions alone.

A document's lines are hashed (the first 32 bits of MD5, so that other engines can say the same). The hash rolls over a window of
one line on either side of a possible boundary: in a grid, a boundary lies before each line of one residue class and after each line
of another. So it depends on two lines only, and a passage that starts with a line of the first class and ends with one of the
second is cut alike wherever it stands. There are ``grids`` such grids, each by another digit of the hash, and the whole text is one more chunk.
What no grid happens to cut is found by its seeds: any two lines that follow each other, blank ones in between aside, are a chunk too, the smallest there is, so every
line of a repeated passage of two lines or more is in a repeated chunk, whatever stands around it. A chunk of several lines that occurs elsewhere too
stays at its first place (smallest doc_id, then place) and is removed from the others, after its bytes were compared; chunks are judged on the
input. A line stays where it occurs first of all.

Chunks are first counted by hash alone. Only those whose hash repeats are compared as bytes; equal ones meet in a partial
aggregate before the shuffle, so a chunk that a third of all rows hold is one row for each task. A text whose whole repeats an
earlier one is compared as a whole only.

Defined cases: a null text stays null and has no lines; an empty text is one empty line; a single line is never a chunk; chunks
of blank lines alone are left; chunks that repeat inside one document keep the first; rows that repeat a doc_id and a text
are one document, so all stay alike; a null doc_id comes after all others; an empty table gives no rows; other columns are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Grids of boundaries. Seeds find what they miss, so they only say which chunks of more than two lines there are.
GRIDS = 2
#: Residue classes of a line's hash: one starts a chunk, one ends it.
CLASSES = 3

#: First and last line (from 1) of a chunk, which share a long.
_FIRST, _LAST = "cast(shiftright(s, 32) as int)", "cast(s & 4294967295 as int)"


def lined(docs: DataFrame) -> DataFrame:
    """docs with _lines."""
    return docs.withColumn("_lines", F.split("text", "\n", -1))


def cut(docs: DataFrame, grids: int = GRIDS) -> DataFrame:
    """lined() with the lines' hashes _h and the chunks of several lines _spans: those of the grids, the seeds and the whole text."""
    hashed = lined(docs).withColumn("_h", F.transform("_lines", lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")))
    digits = ", ".join(f"{CLASSES**g}L" for g in range(grids))
    edge = f"i = size(_h) or (_h[i - 1] div w) % {CLASSES} = 1 or (_h[i] div w) % {CLASSES} = 0"
    ends = f"transform(array({digits}), w -> filter(sequence(1, size(_h)), i -> {edge}))"
    chunk = "shiftleft(cast(if(k = 0, 1, e[k - 1] + 1) as bigint), 32) | cast(x as bigint)"
    spans = f"flatten(transform({ends}, e -> filter(transform(e, (x, k) -> {chunk}), s -> {_FIRST} < {_LAST})))"
    whole = "shiftleft(1L, 32) | cast(size(_h) as bigint)"
    told = hashed.withColumn("_said", F.expr("filter(sequence(1, size(_h)), i -> _lines[i - 1] rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
    seeds = "zip_with(slice(_said, 1, greatest(size(_said) - 1, 0)), slice(_said, 2, greatest(size(_said) - 1, 0)), (a, b) -> shiftleft(cast(a as bigint), 32) | cast(b as bigint))"
    return told.withColumn("_spans", F.expr(f"if(size(_h) < 2, array(), array_distinct(concat({spans}, {seeds}, array({whole}))))")).drop("_said")


def _compared(docs: DataFrame, grids: int, owner: str) -> DataFrame:
    """(doc_id, _t, s, _bytes) of the chunks whose hash repeats, from (doc_id, text, _t)."""
    each = f"transform(_spans, s -> struct(s, xxhash64(slice(_h, {_FIRST}, {_LAST} - {_FIRST} + 1)) as c, s = (shiftleft(1L, 32) | cast(size(_h) as bigint)) as whole))"
    light = cut(docs, grids).select("doc_id", "_t", F.explode(F.expr(each)).alias("x")).select("doc_id", "_t", F.col("x.s").alias("s"), F.col("x.c").alias("_c"), F.col("x.whole").alias("whole"))
    light = scratch.save(light, "chunks", owner)
    often = scratch.save(light.groupBy("_c").agg(F.count("*").alias("n")).where("n > 1").select("_c"), "often", owner)
    hits = scratch.save(light.join(often, "_c"), "hits", owner)
    # later copies of a whole text need no other chunk: what these would meet, the first copy's meet too
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "_t")
    first = scratch.save(hits.where("whole").groupBy("_c").agg(F.min(place).alias("first")), "whole", owner)
    later = hits.where("whole").join(first.hint("merge"), "_c").where(place != F.col("first")).select(F.col("doc_id").alias("_d"), F.col("_t").alias("_u")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_u"))
    hits = hits.join(later.hint("merge"), same, "left").where("whole or _u is null").groupBy("doc_id", "_t").agg(F.collect_set("s").alias("_ks")).withColumnsRenamed({"doc_id": "_d", "_t": "_u"})
    texts = f"transform(_ks, s -> struct(s, array_join(slice(_lines, {_FIRST}, {_LAST} - {_FIRST} + 1), '\\n') as x))"
    found = lined(docs.join(hits.hint("merge"), same)).select("doc_id", "_t", F.explode(F.expr(texts)).alias("x"))
    return found.select("doc_id", "_t", F.col("x.s").alias("s"), F.col("x.x").alias("_bytes")).where(F.expr("_bytes rlike '[^\\\\x20\\\\x09-\\\\x0D]'"))


def removals(docs: DataFrame, grids: int = GRIDS, owner: str = "query") -> DataFrame:
    """What stays of each document that loses lines, which doc_id and a hash of the text name (_d, _u).

    _gaps has (first line, lines) before and between removed chunks, _upto the last line that a chunk removes, _lost how many go.
    """
    named = docs.select("doc_id", "text").where("text is not null").withColumn("_t", F.xxhash64("text"))
    texts = scratch.save(_compared(named, grids, owner), "compared", owner)
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_t", "s")
    first = texts.groupBy("_bytes").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    first = scratch.save(first.drop("n"), "first", owner)
    gone = texts.join(first.hint("merge"), "_bytes").where(place != F.col("first")).select("doc_id", "_t", F.expr(_FIRST).alias("a"), F.expr(_LAST).alias("b")).distinct()
    # chunks of different grids overlap: a chunk that starts behind all before it leaves a gap
    before = F.max("b").over(Window.partitionBy("doc_id", "_t").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    gaps = gone.withColumn("from", F.coalesce(before, F.lit(0)) + 1)
    gap = F.when(F.col("a") > F.col("from"), F.struct("from", (F.col("a") - F.col("from")).alias("n")))
    each = gaps.groupBy(F.col("doc_id").alias("_d"), F.col("_t").alias("_u")).agg(F.sort_array(F.collect_list(gap)).alias("_gaps"), F.max("b").alias("_upto"))
    return each.withColumn("_lost", F.expr("_upto - aggregate(_gaps, 0, (t, g) -> t + g.n)"))


def line_dedup(docs: DataFrame, grids: int = GRIDS, owner: str = "query") -> DataFrame:
    """The rows of ``docs`` with what is left of their texts, and n_lines and n_removed (lines)."""
    gone = scratch.save(removals(docs, grids, owner), "gone", owner)
    held = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64("text").alias("_t"))  # the text moves once, in its row
    rows = held.join(gone.hint("merge"), F.col("_row.doc_id").eqNullSafe(F.col("_d")) & F.col("_t").eqNullSafe(F.col("_u")), "left")
    # only documents that lose something are cut again
    rows = lined(rows.withColumn("text", F.when(F.col("_lost").isNotNull(), F.col("_row.text"))))
    kept = F.expr("array_join(concat(flatten(transform(_gaps, g -> slice(_lines, g.from, g.n))), slice(_lines, _upto + 1, size(_lines) - _upto)), '\n')")
    lines = F.length("_row.text") - F.length(F.translate("_row.text", "\n", "")) + 1
    others = [F.col(f"_row.{c}").alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    text = F.when(F.col("_lost").isNull(), F.col("_row.text")).otherwise(kept).alias("text")
    return rows.select(*others, text, F.coalesce(lines, F.lit(0)).cast("long").alias("n_lines"), F.coalesce("_lost", F.lit(0)).cast("long").alias("n_removed"))


def cleaned(docs: DataFrame, grids: int = GRIDS, owner: str = "query") -> DataFrame:
    """The rows of ``docs`` with what is left of their texts; n_chars follows where there is one. A text that is wholly repeated goes."""
    # the partition's number keeps the optimizer from moving the filter, and with it the work on lines, into the join below
    got = line_dedup(docs, grids, owner).withColumn("_part", F.spark_partition_id()).where("_part >= 0 and (n_removed = 0 or text <> '')")
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return got.select(*docs.columns)
