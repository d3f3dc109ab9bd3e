"""How the sources of a language differ in their terms: a heavy-light split of exact divergences.

A group is a (lang, source); each kept term of a language has a share p in each of its groups, with one added to every count, so the
divergence of two groups sums over all kept terms, those neither has included. The terms are split by the number of groups they occur in:

All terms are first counted as if no group had them, which is one product a pair of groups; what follows are differences from that.

* **Heavy** terms stand in more than LIGHT groups. They are dealt to tiles, each of two blocks of groups and a slice of the terms; a tile is a dense matrix
  of shares and gives the sums of all its pairs of groups.
* A posting of a **light** term corrects the pairs of its group with all others: those corrections depend on the posting's count only, so a group's postings enter as a histogram of counts, again in tiles.
  Where two groups share a light term both corrections were made as if the other one lacked it; that is put right for the pairs of the
  term's posting list, which has LIGHT entries at most.

All partial sums are whole numbers, so adding them gives the exact value. Nothing is collected: counts, groups and sums are tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .blocks import blocks, lowered, spans

#: Documents of a language that a kept term stands in, at least.
DOCS = 3
#: Ranks of part "term".
RANKS = 200
#: Groups that a light term stands in, at most; groups of a block; heavy terms of a slice.
LIGHT, GROUPS, TERMS = 8, 128, 1024
UNIT = 1_000_000_000
#: Bytes of texts whose terms are counted at a time; a longer text is a block of its own.
BLOCK_BYTES = 16 << 20
#: Bytes that are not part of a term.
_GAP = np.zeros(256, bool)
for _low, _high in ((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _GAP[_low : _high + 1] = True


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms and of documents by (lang, source, term), added up over blocks of texts; a null term for each group that occurs in one."""
    for rows, data, offsets in blocks(batches, size=BLOCK_BYTES):
        groups = pa.table({c: rows[c] for c in ("lang", "source")}).append_column("doc", pa.array(np.arange(rows.num_rows, dtype=np.int32)))
        starts, ends, first = spans(data, offsets, _GAP)
        # terms are all bytes but the gaps, so those are the terms' bytes one after the other
        ends_at = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)  # a text of Spark's is shorter than 2^31 bytes
        held = lowered(data[~_GAP[data]])
        term = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends_at), pa.py_buffer(held)])
        doc = pa.array(np.repeat(np.arange(rows.num_rows, dtype=np.int32), np.diff(first)))
        own = pa.table({"doc": doc, "term": term}).group_by(["doc", "term"], use_threads=False).aggregate([([], "count_all")])
        # a group's number is that of its first document here
        numbers = groups.group_by(["lang", "source"], use_threads=False).aggregate([("doc", "min"), ("doc", "list")])
        of = np.zeros(rows.num_rows, np.int32)
        for number, docs in zip(numbers["doc_min"].to_pylist(), numbers["doc_list"], strict=True):
            of[docs.values.to_numpy()] = number
        counts = pa.table({"g": pa.array(of[own["doc"].to_numpy()]), "term": own["term"], "n": own["count_all"]}).group_by(["g", "term"], use_threads=False).aggregate([("n", "sum"), ([], "count_all")])
        present = pa.table({"g": numbers["doc_min"], "term": pa.nulls(numbers.num_rows, pa.string()), "n": pa.array(np.zeros(numbers.num_rows, np.int64)), "docs": pa.array(np.zeros(numbers.num_rows, np.int64))})
        every = pa.concat_tables([present, counts.rename_columns({"n_sum": "n", "count_all": "docs"}).select(present.column_names)])
        named = {c: groups[c].take(every["g"]) for c in ("lang", "source")}
        yield from pa.table(named | {"term": every["term"], "n": every["n"], "docs": every["docs"]}).to_batches(max_chunksize=1 << 16)


def shares(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / size), in steps that stay within 64 bits for sizes below 2^53; 1 for a size of 0, where there is no term."""
    size, rest, out = np.maximum(sizes, 1), counts + 1, np.zeros(np.broadcast(counts, sizes).shape, np.int64)
    for _ in range(3):
        whole, rest = np.divmod(rest * 1000, size)
        out = out * 1000 + whole
    return np.where(sizes > 0, out + 1, 1)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _share(n: str, size: str) -> Column:
    """shares() in SQL."""
    rest, out = f"({n} + 1)", "1L"
    for unit in (1_000_000, 1000, 1):
        out, rest = f"{out} + {unit}L * (({rest} * 1000L) div {size})", f"(({rest} * 1000L) % {size})"
    return F.expr(out)


def tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of a tile's pairs of groups, both ways: (lang, g, h, value). kind 0: a group; 1: a heavy term's posting; 2: postings of light terms with one count."""
    known = pdf[pdf["kind"] == 0].sort_values("g")
    g, size, block = known["g"].to_numpy(), known["size"].to_numpy(), known["block"].to_numpy()
    lo, hi = int(pdf["lo"].iat[0]), int(pdf["hi"].iat[0])
    nil = shares(np.zeros(len(g), np.int64), size)
    out = np.zeros((len(g), len(g)), np.int64)
    if pdf["slice"].iat[0] == 0:
        # all terms, as if no group had them
        out += known["v"].to_numpy()[:, None] * divergence(nil[:, None], nil[None, :])
    heavy = pdf[pdf["kind"] == 1]
    if len(heavy):
        term, _ = pd.factorize(heavy["term"])
        counts = np.zeros((term.max() + 1, len(g)), np.int64)
        counts[term, np.searchsorted(g, heavy["g"].to_numpy())] = heavy["n"].to_numpy()
        p = shares(counts, size[None, :])
        for i in range(len(g)):
            others = np.ones(len(g), bool) if lo == hi else block != block[i]
            # a term that neither block has is in no tile of theirs
            out[i, others] += divergence(p[:, i : i + 1], p[:, others]).sum(axis=0) - len(p) * divergence(nil[i], nil[others])
    light = pdf[pdf["kind"] == 2]
    if len(light):
        at = np.searchsorted(g, light["g"].to_numpy())
        p, times = shares(light["n"].to_numpy(), size[at]), light["times"].to_numpy()
        for i in np.unique(at).tolist():
            own, m = p[at == i][:, None], times[at == i][:, None]
            out[i] += (m * (divergence(own, nil[None, :]) - divergence(nil[i], nil)[None, :])).sum(axis=0)
            out[:, i] += (m * (divergence(nil[None, :], own) - divergence(nil, nil[i])[None, :])).sum(axis=0)
    row, col = np.nonzero(~np.eye(len(g), dtype=bool) if lo == hi else block[:, None] != block[None, :])
    return pd.DataFrame({"lang": pdf["lang"].iat[0], "g": g[row], "h": g[col], "value": out[row, col]})


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections for pairs of groups that share a light term, added up over a batch. Rows (lang, term, g, n, size) are sorted by lang and term."""
    before: pa.Table | None = None

    def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if rows.num_rows < 2:
            return
        langs = pc.dictionary_encode(rows["lang"].combine_chunks())
        code = langs.indices.to_numpy().astype(np.int64)
        starts = np.concatenate(([0], _changes(rows)))
        lengths = np.diff(np.concatenate((starts, [rows.num_rows])))
        g, n, size = (rows[c].to_numpy() for c in ("g", "n", "size"))
        p, nil = shares(n, size), shares(np.zeros(len(n), np.int64), size)
        keys, values = [], []
        for length in np.unique(lengths[lengths > 1]).tolist():
            first = starts[lengths == length]
            for i in range(length):
                for j in range(length):
                    if i != j:
                        a, b = first + i, first + j
                        values.append(divergence(p[a], p[b]) - divergence(p[a], nil[b]) - divergence(nil[a], p[b]) + divergence(nil[a], nil[b]))
                        keys.append((code[a], g[a], g[b]))
        if keys:
            pairs = pa.table({k: pa.array(np.concatenate(x)) for k, x in zip(("c", "g", "h"), zip(*keys, strict=True), strict=True)} | {"value": pa.array(np.concatenate(values))})
            sums = pairs.group_by(["c", "g", "h"], use_threads=False).aggregate([("value", "sum")])
            yield from pa.table({"lang": langs.dictionary.take(sums["c"].combine_chunks()), "g": sums["g"], "h": sums["h"], "value": sums["value_sum"]}).to_batches()

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if before is None else pa.concat_tables([before, rows])
        ends = _changes(rows)
        cut = int(ends[-1]) if len(ends) else 0  # the last term may go on in the next batch
        yield from told(rows.slice(0, cut))
        before = rows.slice(cut)
    if before is not None:
        yield from told(before)


def _changes(rows: pa.Table) -> np.ndarray:
    """Places at which another (lang, term) begins, the first one excepted."""
    other = np.zeros(max(rows.num_rows - 1, 0), bool)
    for c in ("lang", "term"):
        held = rows[c].combine_chunks()
        other |= pc.not_equal(held[1:], held[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(other) + 1


def source_divergence(df: DataFrame, docs: int = DOCS, ranks: int = RANKS, light: int = LIGHT, groups: int = GROUPS, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of ``df`` (text, lang, source); other columns are ignored, whatever their names.

    Part "pair": each other source of the language with the divergence of the group from it, over all kept terms. Part "term": kept
    terms whose share in the group is above that in the language, the ``ranks`` of the highest value. Ties go to the smaller item, in order of UTF-8 bytes.

    Null text, lang and source count as empty; a row is a document, rows that repeat or share an id included. A group without terms has pairs; a language
    without kept terms has pairs of value 0 and no terms; a language with one source has no pairs. An empty table has no rows.
    """
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")]
    counted = df.select(*text).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = scratch.save(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")

    # a term's groups meet once: whether it is kept, how often the language has it, and in how many groups
    term = Window.partitionBy("lang", "term")
    rows = counts.where("term is not null").withColumns({
        "in_docs": F.sum("docs").over(term), "total": F.sum("n").over(term), "spread": F.count("*").over(term), "lead": (F.row_number().over(term.orderBy("source")) == 1).cast("long"),
    })
    kept = scratch.save(rows.where(F.col("in_docs") >= docs).select("lang", "source", "term", "n", "total", "spread", "lead"), "divergence-kept")

    # a row for each group: what it counts, and what its language does
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum("lead").alias("lead"), F.sum(F.when(F.col("spread") > light, F.col("lead")).otherwise(0)).alias("heavy"))
    every = counts.where("term is null").select("lang", "source").join(own, ["lang", "source"], "left").na.fill(0, ["size", "lead", "heavy"])
    lang = Window.partitionBy("lang")
    every = every.withColumns({
        "v": F.sum("lead").over(lang), "heavy": F.sum("heavy").over(lang), "all_size": F.sum("size").over(lang), "n_groups": F.count("*").over(lang), "g": (F.row_number().over(lang.orderBy("source")) - 1).cast("long"),
    })
    every = every.withColumns({"block": F.floor(F.col("g") / groups), "blocks": F.ceil(F.col("n_groups") / groups), "slices": F.greatest(F.ceil(F.col("heavy") / terms), F.lit(1))})
    every = every.withColumns({"size": F.col("size") + F.col("v"), "all_size": F.col("all_size") + F.col("v")})
    every = scratch.save(every.select("lang", "source", "g", "size", "all_size", "v", "block", "blocks", "slices"), "divergence-groups")
    told = kept.join(every, ["lang", "source"])

    # part "term"
    p, q = _share("n", "size"), _share("total", "all_size")
    over = told.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").withColumn("value", F.expr("(p - q) * (p - q) div q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)

    # part "pair"
    none = {"term": F.lit(None).cast("string"), "n": F.lit(0).cast("long"), "times": F.lit(0).cast("long")}
    held = ["lang", "g", "block", "blocks", "slice", "kind", "term", "n", "times", "size", "v"]
    whole = every.withColumns(none | {"kind": F.lit(0), "slice": F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))}).select(*held)
    heavy = told.where(F.col("spread") > light).withColumns({"kind": F.lit(1), "times": F.lit(1).cast("long"), "slice": F.pmod(F.xxhash64("term"), F.col("slices"))}).select(*held)
    few = told.where(F.col("spread") <= light).groupBy("lang", "g", "block", "blocks", "slices", "size", "v", "n").agg(F.count("*").alias("times"))
    few = few.withColumns({"kind": F.lit(2), "term": none["term"], "slice": F.pmod(F.xxhash64("g", "n"), F.col("slices"))}).select(*held)
    other = whole.unionByName(heavy).unionByName(few).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = other.withColumns({"lo": F.least("block", "_b"), "hi": F.greatest("block", "_b")}).drop("_b", "blocks")
    tiles = dealt.groupBy("lang", "lo", "hi", "slice").applyInPandas(tile, "lang string, g long, h long, value long")
    lists = told.where((F.col("spread") <= light) & (F.col("spread") > 1)).select("lang", "term", "g", "n", "size")
    shared = lists.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_shared, "lang string, g long, h long, value long")
    sums = tiles.unionByName(shared).groupBy("lang", "g", "h").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    named = sums.join(every.select("lang", "g", "source"), ["lang", "g"]).join(every.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    pairs = named.select("lang", "source", "item", "value", F.row_number().over(order).alias("rank"))

    parts = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for part, x in (("pair", pairs), ("term", best))]
    return parts[0].unionByName(parts[1])
