"""Best-fit packing of token sequences under several capacities at once (vector best-fit).

Every text is tokenised once, in Arrow batches; only (id, piece, length, checksum) rows go on. Piece lengths lie in
1..capacity, so their histogram is bounded whatever the corpus holds: the driver packs *counts* of lengths, largest
first, and returns runs "items r0..r0+c of length L go to bins b0.. at offset o". Pieces then get their rank within
their length by salted counts (no window spans a whole length), and the rank looks up the run.

A bin is chosen among all open ones that hold the piece in every dimension - tokens, documents, attention cost (the sum
of squared lengths) - by the smallest weighted norm of what would be left, or by the largest weighted dot product of
need and what is left.

Defined cases: a null or empty text is the separator alone (one piece of length 1); rows that repeat a doc_id are packed
as often as they occur; a null doc_id is packed like any other; an empty table gives no rows; columns other than
``id_col`` and ``text_col`` are not read.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, scratch


#: Pieces of one length that are ranked together, about.
RANKED = 1 << 10


def tokenizer_file() -> str:
    """The public byte-level BPE vocabulary; a parameter everywhere."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(2)
def encoder(path: str):
    """The vocabulary of a byte-level ``tokenizers`` file in tiktoken's engine: the same ids in a fifth of the time.

    Such a file writes each byte as a printable character; ids are also the ranks of the merges.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@dataclass(frozen=True)
class Capacity:
    """Of one sequence. ``documents`` and ``attention`` default to values that tokens alone already imply."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    choose: str = "norm"  # or "dot"

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


def plan(counts: dict[int, int], capacity: Capacity) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, items, first bin, offset, items per bin) in which all pieces lie, and the number of bins.

    Bins in one state are kept as ranges of numbers, so the work depends on the lengths that occur, not on the pieces.
    """
    full = capacity.vector()
    weights = np.array(capacity.weights)
    if any(L > full[0] or L * L > full[2] for L in counts):
        raise ValueError("a piece is larger than a sequence")
    states = np.zeros((0, 3), np.int64)  # what is left, by state
    ranges: list[list[list[int]]] = []  # [first bin, bins] by state
    index: dict[tuple, int] = {}
    runs, bins = [], 0

    def put(left: np.ndarray, first: int, n: int) -> None:
        nonlocal states
        if left[0] <= 0 or left[1] <= 0 or left[2] <= 0:
            return
        k = index.get(key := tuple(left.tolist()))
        if k is None:
            k = index[key] = len(ranges)
            ranges.append([])
            states = np.vstack([states, left[None]]) if len(states) <= k else states
        ranges[k].append([first, n])

    for L in sorted(counts, reverse=True):
        n, rank = counts[L], 0
        need = np.array([L, 1, L * L], np.int64)
        while rank < n:
            live = np.flatnonzero((states >= need).all(axis=1) & np.array([bool(r) for r in ranges], bool)) if len(states) else np.zeros(0, int)
            if len(live):
                left = (states[live] - need) / full
                score = -(weights * left**2).sum(axis=1) if capacity.choose == "norm" else (weights * (need / full) * (states[live] / full)).sum(axis=1)
                k = int(live[np.argmax(score)])
                first, have = ranges[k].pop()
                m = min(have, n - rank)
                if m < have:
                    ranges[k].append([first + m, have - m])
                runs.append((L, rank, m, first, int(full[0] - states[k][0]), 1))
                put(states[k] - need, first, m)
                rank += m
            else:
                per = int((full // need).min())
                whole, rest = divmod(n - rank, per)
                if whole:
                    runs.append((L, rank, whole * per, bins, 0, per))
                    put(full - per * need, bins, whole)
                    bins += whole
                if rest:
                    runs.append((L, rank + whole * per, rest, bins, 0, rest))
                    put(full - rest * need, bins, 1)
                    bins += 1
                rank = n
    return np.array(runs, np.int64).reshape(-1, 6), bins


def pieces(docs: DataFrame, capacity: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): whole texts as ids and the separator 0, cut only beyond ``capacity``; a shorter piece comes first."""

    def cut(batches):
        enc = encoder(path)
        for rows, data, offsets in blocks.blocks(batches, text_col):
            keep, out = [], []
            held, at = data.tobytes(), offsets.tolist()
            for i in range(len(at) - 1):
                ids = enc.encode_to_numpy(held[at[i] : at[i + 1]].decode("utf-8", "replace"), allowed_special="all")
                ids = np.append(ids, np.uint32(0)).astype("<u4", copy=False)
                start, k = 0, 0
                while start < len(ids):
                    to = start + ((len(ids) - start) % capacity or capacity) if k == 0 else start + capacity
                    keep.append(i)
                    out.append((k, start, to - start, zlib.crc32(ids[start:to])))
                    start, k = to, k + 1
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(keep)), *cols], names=[id_col, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(cut, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: Capacity = Capacity(), path: str | None = None, id_col: str = "doc_id", text_col: str = "text", owner: str = "query") -> DataFrame:
    """Every piece with its sequence_id and its offset there; sequences are gapless from 0."""
    cut = scratch.save(pieces(docs, capacity.tokens, path or tokenizer_file(), id_col, text_col), "pieces", owner)
    counts = {int(r["length"]): int(r["count"]) for r in cut.groupBy("length").count().collect()}  # one row a length
    # a length has as many salts as it has RANKED pieces; this table has one row a length, at most ``capacity.tokens``
    salts = cut.sparkSession.createDataFrame([(k, -(-n // RANKED)) for k, n in counts.items()], "length long, _salts long")
    salted = cut.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.col("_salts"))).drop("_salts")
    counted = salted.groupBy("length", "_salt").count()
    first = counted.withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    runs, _ = plan(counts, capacity)
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(id_col, "piece", "ids_crc32", "start")) - 1)
    ranked = ranked.join(first, ["length", "_salt"]).select(id_col, "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).alias("_rank"))
    step = int(runs[:, 1].max(initial=0)) + 1
    where = runs[:, 0] * np.int64(step) + runs[:, 1]

    def place(batches):
        for rows in batches:
            length, rank = (rows.column(i).to_numpy() for i in (3, 5))
            k = np.searchsorted(where, length * np.int64(step) + np.minimum(rank, step - 1), "right") - 1
            r = runs[k]
            into = rank - r[:, 1]
            seq, offset = r[:, 3] + into // r[:, 5], r[:, 4] + (into % r[:, 5]) * length
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(5)), pa.array(seq), pa.array(offset)], names=[*rows.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(place, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
