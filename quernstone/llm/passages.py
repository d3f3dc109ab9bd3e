"""Passages that repeat across documents: the plan shared by the byte (suffix) and the word (super-k-mer) operator.

A window is T consecutive units (bytes or words) of one document. Of the k-unit strings in a window the one with the
smallest hash is its anchor; equal windows have equal anchors, so

1. each document emits, for each run of windows that share an anchor, the anchor's hash and a seal (a cryptographic
   digest) of the packed string of the run; a hash that occurs once in the corpus rules out all its windows;
2. of repeated hashes, each run travels as one packed string to the anchor's bucket; copies of a string are merged before
   that by hash and seal, so one holder sends it with the number of its copies;
3. a solver (its own for each operator) finds equal windows in a bucket, comparing what the strings hold;
4. window ranges go back to their documents and are applied to the whole text.

No step pairs documents. A bucket that keeps many different strings (a passage in ever new surroundings or with ever new edits) is cut
again: windows that have about as many units left of the anchor share most of their text, which is the key of a new bucket; the piece that holds
them is a string there, and its copies are merged by a partial aggregate like those of any string. What is still large is cut to single
windows. So neither a bucket nor a window that a third of all rows hold is gathered in one task. Lineage is cut by tables in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, scratch

#: Different strings in a bucket beyond which it is cut again, into so many ranges of windows and then into windows. Results are the same either way.
HOT_BUCKET, RANGES = 1000, 8
#: Bytes of packed strings that a solver sees at once; a bucket is never cut.
SOLVE_BYTES = 1 << 18
#: A run's first window and its number of windows share a long.
_COUNT_BITS = 20
#: Low bits of an anchor candidate's hash that its place in the block takes while hashes are compared: as many in every block. Texts are shorter than 2^31.
_PLACE_BITS = 32


@dataclass(frozen=True)
class Units:
    """What a window counts: ``words`` or bytes."""

    window: int
    anchor: int
    words: bool

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each anchor candidate, each document's first unit (one more at the end), and where units start and end in the bytes."""
        if self.words:
            starts, ends, first = blocks.spans(data, offsets)
            return blocks.runs_of(blocks.word_hashes(data, starts, ends), self.anchor), first, starts, ends
        return blocks.window_hashes(data, self.anchor), offsets, np.zeros(0, np.int64), np.zeros(0, np.int64)


def anchors(hashes: np.ndarray, first: np.ndarray, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: document, first window, windows, anchor's place. Windows never cross documents."""
    none = np.zeros(0, np.int64)
    w = units.window - units.anchor + 1
    if len(hashes) < w:
        return none, none, none, none
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    least = blocks.sliding_min((hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64), w)
    at = (least & mask).astype(np.int64)  # of hashes that are equal in what is compared the first, so a window's anchor depends on nothing around it
    ends = np.repeat(first[1:], np.diff(first))[: len(at)]
    valid = np.arange(len(at)) + units.window <= ends
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
    start = np.flatnonzero(new)
    return np.searchsorted(first, start, "right") - 1, start, np.flatnonzero(last) - start + 1, at[start]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text, which tells apart rows that share a doc_id (or have none)."""
    return docs.select("doc_id", "text").withColumn("th", F.xxhash64("text"))


def ranges(docs: DataFrame, units: Units, solve: Callable, earlier: bool, owner: str) -> DataFrame:
    """(doc_id, th, at array<int>): flat pairs of first and last+1 window, counted in the document, whose windows repeat.

    ``earlier``: only windows that start in a document with a smaller doc_id count; else any other place counts.
    """

    def emit(batches):
        for rows, data, offsets in blocks.blocks(batches):
            hashes, first, starts, ends = units.of(data, offsets)
            doc, start, n, at = anchors(hashes, first, units)
            cuts = pa.array(np.searchsorted(doc, np.arange(rows.num_rows + 1)).astype(np.int32))
            seal = np.frombuffer(b"".join([hashlib.md5(x, usedforsecurity=False).digest()[:8] for x in _packed(data, starts, ends, start, n, units)]), np.int64)
            cols = (hashes[at].view(np.int64), seal, (start - first[doc]) << _COUNT_BITS | n)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), *(pa.ListArray.from_arrays(cuts, pa.array(c)) for c in cols)], names=["doc_id", "th", "h", "r", "p"])

    docs = keyed(docs)
    marks = scratch.save(docs.mapInArrow(emit, "doc_id long, th long, h array<long>, r array<long>, p array<long>").where("size(h) > 0"), "anchors", owner)
    each = marks.selectExpr("doc_id", "th", "inline(arrays_zip(h, r, p))")
    if earlier:
        often = each.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h")
    else:
        often = each.groupBy("h").count().where("count > 1").select("h")
    # a table of its own on either side lets Spark split a hash that many documents hold
    often = scratch.save(often, "often", owner)
    hits = scratch.save(each.join(often, "h"), "hits", owner)
    scratch.drop(docs.sparkSession, marks)
    strings = hits.groupBy("h", "r").agg(F.count("*").alias("c"), F.min("doc_id").alias("d"), F.min(F.struct("doc_id", "th", "p")).alias("o"))
    strings = scratch.save(strings, "strings", owner)
    # one holder sends its string for all copies; where one string fills a bucket, or all of its strings repeat anyway, none travels
    buckets = strings.groupBy("h").agg(F.count("*").alias("m"), F.min("c").alias("least")).where("m > 1" if earlier else "m > 1 and least = 1")
    buckets = scratch.save(buckets, "buckets", owner)
    sent = strings.join(buckets, "h").select(F.col("o.doc_id").alias("_d"), F.col("o.th").alias("_t"), F.struct("h", "r", "c", "d", "m", F.col("o.p").alias("p")).alias("x"))
    sent = sent.groupBy("_d", "_t").agg(F.collect_list("x").alias("x"))  # as many as the document has anchors

    def cut(batches):
        for rows, data, offsets in blocks.blocks(batches):
            hashes, first, starts, ends = units.of(data, offsets)
            doc, start, n, at = anchors(hashes, first, units)
            lists = rows.column(2)
            of = np.repeat(np.arange(rows.num_rows), np.diff(np.asarray(lists.offsets)))
            h, r, c, d, m, p = lists.flatten().flatten()
            run = np.searchsorted(start, first[of] + (p.to_numpy() >> _COUNT_BITS))
            packed = _packed(data, starts, ends, start[run], n[run], units)
            cols = [h, r, c, d, m, pa.array((at - start)[run].astype(np.int32)), pa.array(n[run].astype(np.int32)), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "r", "c", "d", "m", "off", "n", "s"])

    joined = docs.join(sent, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("th").eqNullSafe(F.col("_t"))).select("doc_id", "text", "x")
    travel = scratch.save(joined.mapInArrow(cut, "h long, r long, c long, d long, m long, off int, n int, s binary"), "travel", owner)

    def again(strings: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
        """The pieces of hot buckets' strings, and the different ones among them with the sizes of their new buckets."""
        shape = "h long, r long, c long, d long, h2 long, r2 long, lo int, off int, n int, s binary"
        dealt = scratch.save(strings.where(F.col("m") > HOT_BUCKET).mapInArrow(_deal(units, width), shape), "dealt", owner)
        merged = dealt.groupBy(F.col("h2").alias("h"), F.col("r2").alias("r")).agg(F.sum("c").alias("c"), F.min("d").alias("d"), F.min("off").alias("off"), F.min("n").alias("n"), F.min("s").alias("s"))
        merged = scratch.save(merged, "pieces", owner)
        sizes = scratch.save(merged.groupBy("h").agg(F.count("*").alias("m")), "sizes", owner)
        return dealt, merged.join(sizes.hint("merge"), "h")

    first_cut, ranged = again(travel, -(-(units.window - units.anchor + 1) // RANGES))
    second_cut, single = again(ranged, 1)

    def work(batches):
        for group in _buckets(batches):
            yield solve(group, units)

    runs = "array<struct<a:int,b:int,d:bigint>>"
    cold = travel.where(F.col("m") <= HOT_BUCKET).unionByName(ranged.where((F.col("m") > 1) & (F.col("m") <= HOT_BUCKET))).select("h", "r", "c", "d", "s", "n")
    solved = cold.repartition("h").sortWithinPartitions("h").mapInArrow(work, f"h long, r long, runs {runs}")
    every = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"), F.col("d").alias("d"))).cast(runs).alias("runs")
    for pieces in (ranged, single):
        solved = solved.unionByName(pieces.where("c > 1").select("h", "r", every))
    solved = scratch.save(solved, "solved", owner)

    def back(dealt: DataFrame, solved: DataFrame) -> DataFrame:
        """What was found in pieces, for the strings that they were cut from."""
        found = dealt.select("h", "r", "h2", "r2", "lo").join(solved.select(F.col("h").alias("h2"), F.col("r").alias("r2"), "runs"), ["h2", "r2"])
        moved = F.expr("transform(runs, x -> struct(x.a + lo as a, x.b + lo as b, x.d as d))")
        return found.groupBy("h", "r").agg(F.flatten(F.collect_list(moved)).cast(runs).alias("runs"))

    solved = solved.unionByName(back(second_cut, solved))
    solved = solved.unionByName(back(first_cut, solved))
    # a string that occurs several times repeats as a whole; solvers add what different strings share
    whole = F.array(F.struct(F.lit(0).alias("a"), F.expr(f"cast(o.p & {(1 << _COUNT_BITS) - 1} as int)").alias("b"), F.col("d").alias("d"))).cast(runs)
    solved = scratch.save(solved.unionByName(strings.where("c > 1").select("h", "r", whole.alias("runs"))), "solved", owner)
    got = hits.join(solved, ["h", "r"]).withColumn("pos", F.expr(f"cast(shiftright(p, {_COUNT_BITS}) as int)"))
    if earlier:
        got = got.withColumn("runs", F.expr("filter(runs, x -> x.d < doc_id)"))
    flat = F.expr("flatten(transform(runs, x -> array(pos + x.a, pos + x.b)))")
    return got.where("size(runs) > 0").groupBy("doc_id", "th").agg(F.flatten(F.collect_list(flat)).alias("at"))


def _packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, run: np.ndarray, n: np.ndarray, units: Units) -> list[bytes]:
    """The units under each run of windows as one string; words are joined by one space."""
    last = run + n + units.window - 1
    if not units.words:
        held = data.tobytes()
        return [held[x:y] for x, y in zip(run.tolist(), last.tolist(), strict=True)]
    keep = np.zeros(len(data) + 1, np.int8)  # words and the first space after each
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends, -1)
    inside = np.cumsum(keep[:-1]).astype(bool)
    after = ends[ends < len(data)]
    plain = np.where(inside, data, np.uint8(32))
    inside[after] = True
    # a word that touches the next document's has no byte between them, and needs none: runs stay within documents
    where = np.cumsum(inside) - inside
    held = plain[inside].tobytes()
    return [held[x:y] for x, y in zip(where[starts[run]].tolist(), (where[ends[last - 1] - 1] + 1).tolist(), strict=True)]


def _places(packed: bytes, units: Units) -> tuple[list[int], list[int]]:
    """Where the units of a packed string start and end."""
    if not units.words:
        return [*range(len(packed))], [*range(1, len(packed) + 1)]
    cut = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32)
    return [0, *(cut + 1).tolist()], [*cut.tolist(), len(packed)]


def windows(packed: bytes, n: int, units: Units) -> list[bytes]:
    """The ``n`` windows of a packed string."""
    starts, ends = _places(packed, units)
    return [packed[starts[j] : ends[j + units.window - 1]] for j in range(n)]


def _deal(units: Units, width: int) -> Callable:
    """Cuts strings into pieces, each with the windows that have ``width`` neighbouring numbers of units left of the anchor.

    All windows that can be in a piece share the text between the outermost of them: its hash is the piece's bucket h2, and r2 its
    own name. ``lo`` is the string's window that comes first in the piece, ``off`` the anchor's place in it.
    """

    def name(text: bytes, *numbers: int) -> int:
        return int.from_bytes(hashlib.blake2b(text, digest_size=8, key=b"".join(x.to_bytes(8, "big", signed=True) for x in numbers)).digest(), "big", signed=True)

    def deal(batches):
        for rows in batches:
            col = {c: rows.column(rows.schema.get_field_index(c)) for c in rows.schema.names}
            take, out = [], []
            for i, (h, s, off, n) in enumerate(zip(*(col[c].to_pylist() for c in ("h", "s", "off", "n")), strict=True)):
                starts, ends = _places(s, units)
                for k in range((off - n + 1) // width if off >= n else 0, off // width + 1):
                    # windows of the range start at off - k * width and at up to width - 1 places before
                    a, b = max(0, off - (k + 1) * width + 1), min(n, off - k * width + 1)
                    if a < b:
                        common = s[starts[off - k * width] : ends[off - (k + 1) * width + units.window]]
                        piece = s[starts[a] : ends[b + units.window - 2]]
                        take.append(i)
                        out.append((name(common, h, k, width), name(piece, off - a), a, off - a, b - a, piece))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(col[c].take(pa.array(take, pa.int64())) for c in ("h", "r", "c", "d")), *cols], names=["h", "r", "c", "d", "h2", "r2", "lo", "off", "n", "s"])

    return deal


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole buckets, about SOLVE_BYTES at a time, from rows sorted by h; buckets of one string are left out."""
    held: list[pa.RecordBatch] = []
    size = 0

    def ready(parts: list[pa.RecordBatch]) -> Iterator[pa.Table]:
        table = pa.Table.from_batches(parts).combine_chunks()
        keys = table.column("h").to_numpy()
        same = np.flatnonzero(keys[1:] == keys[:-1])
        several = np.zeros(len(keys), bool)
        several[same] = several[same + 1] = True
        table = table.filter(pa.array(several))
        if table.num_rows:
            yield table

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index("h")).to_numpy()
        s = batch.column(batch.schema.get_field_index("s"))
        ends = np.cumsum(np.asarray(pc.binary_length(s)))
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1  # where a bucket may end
        at = 0
        if held and keys[0] != held[-1].column(held[-1].schema.get_field_index("h"))[-1].as_py() and size >= SOLVE_BYTES:
            yield from ready(held)
            held, size = [], 0
        for e in edges.tolist():
            done = int(ends[e - 1] - (ends[at - 1] if at else 0))
            if size + done >= SOLVE_BYTES:
                yield from ready([*held, batch.slice(at, e - at)])
                held, size, at = [], 0, e
        held.append(batch.slice(at))
        size += int(ends[-1] - (ends[at - 1] if at else 0))
    if held:
        yield from ready(held)


def apply(docs: DataFrame, found: DataFrame, finish: Callable, shape: str) -> DataFrame:
    """``finish(rows, data, offsets, cuts, flat)`` over every document with its window ranges."""

    def run(batches):
        for rows, data, offsets in blocks.blocks(batches):
            at = rows.column(2)
            at = at.fill_null([]) if at.null_count else at
            lists = np.asarray(at.offsets)
            yield finish(rows, data, offsets, lists - lists[0], np.asarray(at.flatten()))

    found = found.withColumnsRenamed({"doc_id": "_d", "th": "_t"})
    docs = keyed(docs)
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("th").eqNullSafe(F.col("_t")), "left").select("doc_id", "text", F.coalesce("at", F.array().cast("array<int>")).alias("at")).mapInArrow(run, shape)
