"""Documents whose word n-grams reach a Jaccard threshold: size-banded tiles with hashed bitmap signatures.

A link needs len(x) - ceil(t * len(x)) + 1 of a document's n-grams, the first in any fixed order, to hold one of the
other's. The order puts n-grams known to be frequent last, so shared boilerplate opens no groups. Within the group of
such an n-gram:

1. its smallest doc_id is a centre, and each document is compared with the centre that most of its groups name (one row a
   document, no pairs among members);
2. members that this links are one component. Groups that still hold several are put together by their largest component;
   what is outside it is compared with all, in tiles of bounded size ordered and banded by set size (sizes far apart cannot
   link);
3. a comparison first bounds the overlap from above by bit counts: a bit is the parity of the elements that fall on it, so each bit
   that differs between two signatures is an element of one set only. What survives is decided by intersecting the sorted arrays
   exactly, in tiles of bounded bytes that get each document's array once, however many of their pairs it is in.

Copies cost one comparison each, and no link between components is lost, so components are exact.

Defined cases: a document with fewer than n words is one n-gram of all its words; without words (or null) its set is empty
and links with nothing; a null doc_id links with nothing and has a null component; rows that repeat a doc_id are one node
that has the links of each; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, scratch
from .components import components

#: N-grams whose frequency is known to every task; the order of all others is their hash. It only affects speed.
FREQUENT = 300_000
#: Members of a tile.
TILE = 1024
#: Members up to which a plain loop over pairs is faster.
FEW = 128
#: N-grams of one side of a tile in which pairs are decided.
BLOCK = 2_000_000
BITS = (64, 32768)
#: Bits of a signature for each element, at least: the more, the closer the bound.
SPARSE = 1


@dataclass(frozen=True)
class Likeness:
    """Link when den * intersection >= num * union of the n-word shingles."""

    n: int = 5
    num: int = 80
    den: int = 100

    def prefix(self, size: int) -> int:
        return size + self.num * size // -self.den + 1 if size else 0

    def least(self, a, b):
        """Smallest intersection that links sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))


def signature(grams: np.ndarray) -> bytes:
    """The parity of the elements on each bit; a larger one folds to a smaller one by halves."""
    bits = min(BITS[1], max(BITS[0], 1 << int(SPARSE * len(grams) - 1).bit_length()))
    on = (np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(on, bitorder="little").tobytes()


def fold(sig: np.ndarray, size: int) -> np.ndarray:
    """The last axis folded to ``size`` words."""
    return sig if sig.shape[-1] == size else np.bitwise_xor.reduce(sig.reshape(*sig.shape[:-1], -1, size), axis=-2)


def most_shared(a: np.ndarray, b: np.ndarray, na, nb):
    """Upper bound of the overlap of sets with these signatures (last axis) and sizes."""
    size = min(a.shape[-1], b.shape[-1])
    return (na + nb - np.bitwise_count(fold(a, size) ^ fold(b, size)).sum(axis=-1, dtype=np.int64)) // 2


def _frequent(docs: DataFrame, like: Likeness, owner: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that most often repeat within a block, with their counts: at most FREQUENT of them reach the driver."""

    def count(batches):
        for _, data, offsets in blocks.blocks(batches, size=2 << 20):
            h, c = np.unique(np.concatenate([*blocks.shingles(data, offsets, like.n), np.zeros(0, np.uint64)]), return_counts=True)
            often = c >= 3
            yield pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(c[often])], names=["h", "c"])

    every = docs.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).withColumn("k", F.floor(F.log2("c") * 8).cast("int"))
    every = scratch.save(every, "frequent", owner)
    # classes of counts, from the top, as long as they fit: neither the driver nor a task sees more than FREQUENT n-grams
    room, least = FREQUENT, None
    for k, n in sorted(((r["k"], r["count"]) for r in every.groupBy("k").count().collect()), reverse=True):
        room -= n
        if room < 0:
            break
        least = k
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = every.where(F.col("k") >= least).toPandas()
    scratch.drop(docs.sparkSession, every)
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], top["c"].to_numpy(np.int64)[order]


def _marks(docs: DataFrame, like: Likeness, owner: str) -> DataFrame:
    """doc_id, set size, signature and prefix of each row."""
    known, often = _frequent(docs, like, owner)

    def mark(batches):
        for rows, data, offsets in blocks.blocks(batches):
            sizes, sigs, prefixes = [], [], []
            for grams in blocks.shingles(data, offsets, like.n):
                sizes.append(len(grams))
                sigs.append(signature(grams) if len(grams) else b"")
                if len(known) and len(grams):
                    k = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                    c = np.where(known[k] == grams, often[k], 0)
                    if c.any():
                        grams = grams[np.argsort(c, kind="stable")]
                prefixes.append(grams[: like.prefix(len(grams))])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), blocks.lists(prefixes, pa.int64())], names=["doc_id", "n", "sig", "prefix"])

    return docs.mapInArrow(mark, "doc_id long, n long, sig binary, prefix array<long>")


def _bounded(pairs: DataFrame, marks: DataFrame, like: Likeness) -> DataFrame:
    """Pairs (a, b) that sizes and bit counts allow to link."""
    side = marks.where("doc_id is not null and n > 0")
    of = lambda x: side.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    wide = pairs.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").where(f"{like.den} * least(na, nb) >= {like.num} * greatest(na, nb)")

    def bound(batches):
        for rows in batches:
            get = lambda c: rows.column(rows.schema.get_field_index(c))  # noqa: E731, B023
            na, nb = get("na").to_numpy(), get("nb").to_numpy()
            need = like.least(na, nb)
            keep = [int(most_shared(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), p, q)) >= r for x, y, p, q, r in zip(get("sa").to_pylist(), get("sb").to_pylist(), na.tolist(), nb.tolist(), need.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([get("a"), get("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return wide.mapInArrow(bound, "a long, b long").distinct()


def _sets(pairs: DataFrame, docs: DataFrame, like: Likeness, owner: str) -> DataFrame:
    """(doc_id, grams) of the pairs' documents, whose whole texts are read again."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()

    def sets(batches):
        for rows, data, offsets in blocks.blocks(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), blocks.lists(list(blocks.shingles(data, offsets, like.n)), pa.int64())], names=["doc_id", "grams"])

    return scratch.save(docs.join(ids.hint("merge"), "doc_id").mapInArrow(sets, "doc_id long, grams array<long>"), "sets", owner)


def _linked(pairs: DataFrame, docs: DataFrame, like: Likeness, owner: str) -> DataFrame:
    """Pairs whose exact intersection links them. Sets travel with each pair, so there should be few of a document."""
    held = _sets(pairs, docs, like, owner)

    def intersect(batches):
        for rows in batches:
            get = lambda c: rows.column(rows.schema.get_field_index(c))  # noqa: E731, B023
            x, y = get("x"), get("y")
            xs, ys, xo, yo = (np.asarray(v) for v in (x.flatten(), y.flatten(), x.offsets, y.offsets))
            xo, yo = xo - xo[0], yo - yo[0]
            keep = []
            for i in range(rows.num_rows):
                p, q = xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]]
                keep.append(len(np.intersect1d(p, q, assume_unique=True)) >= like.least(len(p), len(q)))
            yield pa.RecordBatch.from_arrays([get("a"), get("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda a, x: held.select(F.col("doc_id").alias(a), F.col("grams").alias(x))
    found = pairs.join(of("a", "x").hint("merge"), "a").join(of("b", "y").hint("merge"), "b").mapInArrow(intersect, "a long, b long").distinct()
    found = scratch.save(found, "links", owner)
    scratch.drop(docs.sparkSession, held)
    return found


def _linked_in_tiles(pairs: DataFrame, docs: DataFrame, like: Likeness, owner: str) -> DataFrame:
    """Links that connect what the pairs (a, b) link, decided exactly tile by tile.

    Documents that pairs connect are a family, dealt to blocks of about BLOCK n-grams; two blocks of a family are a tile. It gets the sets of its documents
    once each and then its pairs; one that links found before already connect is not compared."""
    held = _sets(pairs, docs, like, owner)
    family = scratch.save(components(pairs, owner).withColumnRenamed("node", "doc_id"), "families", owner)
    counts = family.join(held.select("doc_id", F.size("grams").alias("n")).hint("merge"), "doc_id").groupBy("component").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("p"))
    placed = family.join(counts.hint("merge"), "component").select("component", "p", F.pmod(F.xxhash64("doc_id"), "p").alias("i"), F.col("doc_id").alias("a"))
    met = pairs.join(placed.hint("merge"), "a").withColumn("j", F.pmod(F.xxhash64("b"), "p"))
    pairs = scratch.save(met.select(F.xxhash64("component", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "a", "b"), "tiles", owner)
    ids = pairs.select("key", F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    none = lambda kind: F.lit(None).cast(kind)
    sets = ids.join(held.hint("merge"), "doc_id").select("key", F.lit(0).alias("kind"), F.col("doc_id").alias("a"), none("long").alias("b"), "grams")
    rows = sets.unionByName(pairs.select("key", F.lit(1).alias("kind"), "a", "b", none("array<long>").alias("grams")))

    def decide(batches):
        key, known, root = None, {}, {}

        def top(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for batch in batches:
            grams = batch.column(4)
            values, at = grams.values.to_numpy(zero_copy_only=False), grams.offsets.to_numpy()
            out = ([], [])
            for i, (k, kind, a, b) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)):
                if k != key:
                    key, known, root = k, {}, {}
                if kind == 0:
                    known.setdefault(a, []).append(values[at[i] : at[i + 1]].copy())
                elif top(a) != top(b) and any(len(np.intersect1d(x, y, assume_unique=True)) >= like.least(len(x), len(y)) for x in known[a] for y in known[b]):
                    root[top(a)] = top(b)
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    found = rows.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(decide, "a long, b long").distinct()
    found = scratch.save(found, "links", owner)
    for used in (held, family, pairs):
        scratch.drop(docs.sparkSession, used)
    return found


def _tiles(members: DataFrame, like: Likeness) -> DataFrame:
    """Pairs of different components that a bit count allows, from (g, m, s, minor, doc_id, n, sig, comp).

    m is the group's size and s the number of its members outside its largest component (``minor``). A group of at most TILE
    members is one tile, in order of set size. A larger one is cut into bands of set size, of which only neighbouring ones can link,
    and by hash: tiles of minor members meet tiles of all members of their band and the two beside it. Tiles come one after the
    other from a sorted partition; only what survives leaves them.
    """
    row = ["doc_id", "n", "sig", "comp"]
    whole = members.where(F.col("m") <= TILE).select(F.xxhash64("g").alias("key"), F.lit(2).alias("side"), *row)
    band = F.floor(F.log("n") / float(np.log(like.den / like.num)) + 1e-9)
    cut = members.where(F.col("m") > TILE).withColumns({"band": band, "p": F.ceil(F.col("s") / TILE).cast("int"), "q": F.ceil(F.col("m") / TILE).cast("int")})
    own = lambda of: F.pmod(F.xxhash64("doc_id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = cut.where("minor").withColumns({"i": own("p"), "j": every("q")}).withColumns({"side": F.lit(0), "band": F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1))})
    right = cut.withColumns({"j": own("q"), "i": every("p")}).withColumn("side", F.lit(1))
    meet = lambda df: df.select(F.xxhash64("g", "band", "i", "j").alias("key"), "side", *row)
    rows = whole.unionByName(meet(left)).unionByName(meet(right))

    def run(batches):
        for tile in _sorted_groups(batches):
            a, b = _compare(tile, like)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key", "side", "n").mapInArrow(run, "a long, b long").where("a <> b").distinct()


def _sorted_groups(batches):
    """Rows (side, doc_id, n, sig, comp) of each key, from batches sorted by key."""
    key, held = None, []
    for batch in batches:
        for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if len(held) > 1:
                    yield held
                key, held = k, []
            held.append(row)
    if len(held) > 1:
        yield held


def _compare(tile: list, like: Likeness) -> tuple[list[int] | np.ndarray, list[int] | np.ndarray]:
    """Pairs (smaller doc_id, larger) of the tile that sizes and bit counts allow."""
    if len(tile) > FEW:
        return _compare_many(tile, like)
    out: tuple[list[int], list[int]] = ([], [])
    bits = [(int.from_bytes(r[3], "little"), len(r[3]) * 8) for r in tile]
    edge = sum(r[0] == 0 for r in tile)
    for x, (side, doc, n, _, comp) in enumerate(tile):
        if side == 1:
            continue
        u, wide = bits[x]
        for y in range(x + 1 if side == 2 else edge, len(tile)):
            _, doc2, n2, _, comp2 = tile[y]
            if comp == comp2:
                continue
            if like.den * min(n, n2) < like.num * max(n, n2):
                if n2 > n:
                    break  # sizes only grow from here
                continue
            p, q = u, bits[y][0]
            size, size2 = wide, bits[y][1]
            while size > size2:
                size //= 2
                p = (p >> size) ^ (p & ((1 << size) - 1))
            while size2 > size:
                size2 //= 2
                q = (q >> size2) ^ (q & ((1 << size2) - 1))
            if (n + n2 - (p ^ q).bit_count()) // 2 >= like.least(n, n2):
                out[0].append(min(doc, doc2))
                out[1].append(max(doc, doc2))
    return out


def _compare_many(tile: list, like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """_compare() of a large tile, a row against all others at once. Rows are in order of (side, set size): side 0 meets side 1, side 2 itself."""
    side, doc, n, comp = (np.array([r[c] for r in tile], np.int64) for c in (0, 1, 2, 4))
    width = np.array([len(r[3]) for r in tile])
    edge, total = int((side == 0).sum()), len(tile)
    of = {int(w): np.flatnonzero(width == w) for w in np.unique(width)}
    sigs = {w: np.frombuffer(b"".join(tile[i][3] for i in at), np.uint64).reshape(len(at), -1) for w, at in of.items()}
    folded = {(w, v): fold(sigs[w], v // 8) for w in of for v in of if v <= w}
    row = {int(i): (int(w), k) for w, at in of.items() for k, i in enumerate(at)}
    found: list[tuple[np.ndarray, np.ndarray]] = [(doc[:0], doc[:0])]
    for x in range(edge if edge else total if side[0] == 2 else 0):
        w, k = row[x]
        first = max(x + 1, edge)  # sizes grow from there on
        low = first + int(np.searchsorted(n[first:], -(-like.num * n[x] // like.den)))
        high = first + int(np.searchsorted(n[first:], like.den * n[x] // like.num, "right"))
        for v, at in of.items():
            i, j = np.searchsorted(at, (low, high))
            if i == j:
                continue
            ys, size = at[i:j], min(v, w)
            overlap = (n[x] + n[ys] - np.bitwise_count(folded[v, size][i:j] ^ folded[w, size][k]).sum(axis=1, dtype=np.int64)) // 2
            ys = ys[(overlap >= like.least(n[x], n[ys])) & (comp[ys] != comp[x])]
            if len(ys):
                found.append((np.minimum(doc[x], doc[ys]), np.maximum(doc[x], doc[ys])))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def ngram_join(docs: DataFrame, like: Likeness = Likeness(), owner: str = "query") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs, spark = docs.select("doc_id", "text"), docs.sparkSession
    marks = scratch.save(_marks(docs, like, owner), "marks", owner)
    tokens = marks.where("doc_id is not null").select("doc_id", F.explode("prefix").alias("t"))
    groups = tokens.groupBy("t").agg(F.min("doc_id").alias("c"), F.max("doc_id").alias("z"), F.count("*").alias("m"), F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")).alias("f")).where("c < z")
    groups = scratch.save(groups, "groups", owner)  # both sides tables: Spark can split a frequent n-gram
    shared = scratch.save(tokens.join(groups.hint("merge"), "t"), "groups", owner)
    scratch.drop(spark, groups)
    # of the centres that a document's groups name, the one that most of them do
    votes = shared.where("doc_id <> c").groupBy("doc_id", "c").agg(F.count("*").alias("v"))
    star = votes.groupBy("doc_id").agg(F.max_by("c", F.struct("v", -F.col("c"))).alias("a")).select("a", F.col("doc_id").alias("b"))
    star = scratch.save(star, "star", owner)
    near = scratch.save(_bounded(star, marks, like), "pairs", owner)
    links = _linked(near, docs, like, owner)
    scratch.drop(spark, near)
    parts = scratch.save(components(links, owner), "components", owner)
    # groups with several components left, each set of members once
    placed = scratch.save(shared.join(parts.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").select("t", "c", "z", "m", "f", "doc_id", F.coalesce("component", "doc_id").alias("comp")), "placed", owner)
    scratch.drop(spark, shared)
    sizes = placed.groupBy("t", "c", "z", "m", "f", "comp").agg(F.count("*").alias("k"))
    open_ = sizes.groupBy("t", "c", "z", "m", "f").agg(F.max_by("comp", F.struct("k", -F.col("comp"))).alias("main"), F.max("k").alias("k")).where("k < m")
    open_ = open_.groupBy("c", "z", "m", "f").agg(F.min(F.struct("t", "main")).alias("x")).select("c", "z", "m", "x.t", "x.main")
    # a group of two that the first comparison was about needs no second one
    pair = (F.col("m") == 2) & (F.col("c") == F.col("a")) & (F.col("z") == F.col("b"))
    open_ = scratch.save(open_.join(star.hint("merge"), pair, "left_anti").select("t", "main"), "open", owner)
    # groups around one main component are compared as one: near copies share many n-grams, with almost the same members each time
    members = placed.join(open_.hint("merge"), "t").select(F.col("main").alias("g"), "doc_id", "comp").distinct().withColumn("minor", F.col("comp") != F.col("g"))
    members = scratch.save(members, "members", owner)
    for used in (placed, open_, star):
        scratch.drop(spark, used)
    sizes = scratch.save(members.groupBy("g").agg(F.count("*").alias("m"), F.sum(F.col("minor").cast("int")).alias("s")), "sizes", owner)
    signed = members.join(sizes.hint("merge"), "g").join(marks.where("n > 0").select("doc_id", "n", "sig").hint("merge"), "doc_id")
    rest = scratch.save(_tiles(signed, like), "pairs", owner)
    for used in (members, sizes):
        scratch.drop(spark, used)
    if not rest.isEmpty():
        links = links.unionByName(_linked_in_tiles(rest, docs, like, owner))
        parts = scratch.save(components(links, owner), "components", owner)
    return marks.select("doc_id", F.col("n").alias("n_shingles")).join(parts.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, like: Likeness = Likeness(), owner: str = "query") -> DataFrame:
    """All rows but those whose component holds a smaller doc_id."""
    drop = ngram_join(docs, like, owner).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(drop.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
