"""Repeated substrings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Removed is each byte that a window of ``length`` bytes covers which also starts anywhere else, in the same document or
another. passages.ranges() brings the strings that may hold such a window together; here a bucket's strings are
concatenated, their suffixes sorted as far as ``length`` needs, and the transform is extended backwards breadth-first:
level l marks the places of the suffix array whose common prefix is l, found from those of level l - 1. After
``length`` levels the unmarked places are the repeats.

Defined cases: null and empty texts have no bytes and lose none; texts below ``length`` lose none; of exact copies of a
longer text every copy loses all bytes (each starts elsewhere too), also where the copies share a doc_id; a null doc_id is
a document like any other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import passages

END = 0xFF  # in no UTF-8 text


def suffix_order(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` bytes at least, and where the first 8 differ from the suffix before. Groups that are still tied double their depth, the others rest."""
    n = len(data)
    padded = np.concatenate([data, np.full(8, END, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    eight = new.copy()
    rank = np.empty(n + depth * 2, np.int64)
    rank[n:] = -1

    def ranked(where: np.ndarray, heads: np.ndarray) -> None:
        rank[order[where]] = where[np.maximum.accumulate(np.where(heads, np.arange(len(where)), 0))]

    ranked(np.arange(n), new)
    d = 8
    while d < depth:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        sub = order[tied]
        pair = (rank[sub] * np.int64(n + 1)) + rank[sub + d] + 1
        by = np.argsort(pair, kind="stable")
        order[tied] = sub[by]
        pair = pair[by]
        heads = np.ones(len(tied), bool)
        heads[1:] = pair[1:] != pair[:-1]
        new[tied] = heads
        ranked(tied, heads)
        d *= 2
    return order, eight


def repeats(data: np.ndarray, length: int) -> np.ndarray:
    """Which positions start ``length`` bytes that start elsewhere in ``data`` too."""
    n = len(data)
    order, marked = suffix_order(data, length + 1)
    bwt = data[order - 1]
    by = np.argsort(bwt, kind="stable").astype(np.int32)  # the j-th suffix extends the one at by[j] by a byte to the left
    left = np.empty(n, np.int32)
    left[by] = np.arange(n, dtype=np.int32)  # and the one at i is extended to the left by the one at left[i]
    char = bwt[by]
    head = np.ones(n, bool)
    head[1:] = char[1:] != char[:-1]
    after = np.append(by[1:], np.int32(n))  # where the same byte next precedes a suffix
    before = np.append(np.int32(0), by[:-1])
    marked |= head
    level, front = 8, np.flatnonzero(marked)[1:]
    while level < length and len(front):
        marks = np.flatnonzero(marked)
        first = marks[np.searchsorted(marks, front) - 1]
        size = front - first
        total = int(size.sum())
        open_ = n - len(marks)
        if total <= 2 * open_:
            # the interval that ends at each new mark: the last place of each of its bytes leads to a mark one level up
            at = np.repeat(front - np.cumsum(size), size) + np.arange(total)
            j = left[at] + 1
            j = j[(j < n) & (after[left[at]] >= np.repeat(front, size))]
            front = np.unique(j[~marked[j]])
        else:
            # intervals are long: look at each unmarked place instead
            places = np.flatnonzero(~marked)
            sums = np.cumsum(marked, dtype=np.int32)
            front = places[sums[by[places]] > sums[before[places]]]
        marked[front] = True
        level += 1
    marked = np.append(marked, True)
    out = np.zeros(n, bool)
    out[order] = ~marked[:-1] | ~marked[1:]
    return out


def solve(table: pa.Table, units: passages.Units) -> pa.RecordBatch:
    """Ranges of repeated windows of the strings that occur once; the others are known to repeat."""
    strings = table.column("s").to_pylist()
    data = np.frombuffer(bytes([END]).join(strings) + bytes([END]), np.uint8)
    dup = repeats(data, units.window)
    starts = np.cumsum([0, *(len(s) + 1 for s in strings)])
    hs, ids, runs = [], [], []
    once, n = table.column("c").to_numpy() == 1, table.column("n").to_numpy()
    for i in np.flatnonzero(once).tolist():
        flags = np.zeros(n[i] + 2, np.int8)
        flags[1:-1] = dup[starts[i] : starts[i] + n[i]]
        turn = np.flatnonzero(np.diff(flags))
        if len(turn):
            hs.append(table.column("h")[i].as_py())
            ids.append(table.column("r")[i].as_py())
            runs.append([{"a": a, "b": b, "d": None} for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)])
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("d", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(ids, pa.int64()), pa.array(runs, kind)], names=["h", "r", "runs"])


def spans(flat: np.ndarray, window: int) -> np.ndarray:
    """Disjoint maximal [start, end) units under the windows of the ranges."""
    if not len(flat):
        return np.zeros((0, 2), np.int64)
    got = flat.reshape(-1, 2).astype(np.int64)
    got = got[np.argsort(got[:, 0], kind="stable")]
    a, b = got[:, 0], np.maximum.accumulate(got[:, 1] + window - 1)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    heads = np.flatnonzero(new)
    return np.stack([a[heads], np.append(b[heads[1:] - 1], b[-1])], axis=1)


def suffix_dedup(docs: DataFrame, length: int = 200, anchor: int = 40, text: bool = False, owner: str = "query") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row; ``text`` adds what is left (binary, as a cut may fall inside a character) and the removed spans."""
    units = passages.Units(length, anchor, False)
    found = passages.ranges(docs, units, solve, False, owner)

    def finish(rows, data, offsets, cuts, flat):
        cols: list[list] = [[], [], [], [], [], []]
        held = data.tobytes()
        for i in range(rows.num_rows):
            doc = held[offsets[i] : offsets[i + 1]]
            gone = spans(flat[cuts[i] : cuts[i + 1]], length).tolist()
            kept, at = [], 0
            for a, b in gone:
                kept.append(doc[at:a])
                at = b
            left = b"".join([*kept, doc[at:]])
            for c, v in zip(cols, (len(doc), len(doc) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left, gone), strict=True):
                c.append(v)
        arrays = [rows.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64()))), strict=True))]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
        return pa.RecordBatch.from_arrays(arrays if text else arrays[:5], names=names if text else names[:5])

    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<array<long>>" * text
    return passages.apply(docs, found, finish, shape)
