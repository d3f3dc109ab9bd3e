"""Repeated word passages by super-k-mer partitioning.

Removed is each word that a window of ``length`` words covers whose words also start in a document with a smaller
doc_id. The windows of a run that share a minimiser travel as one packed string (passages.ranges()); in a bucket all
windows of its strings are sorted and equal neighbours share the smallest doc_id.

Defined cases: null, empty and blank texts have no words; texts below ``length`` words lose none; repeats inside one
document, and in rows that share a doc_id, are not removed; a null doc_id is never smaller nor larger than another, so
its row loses nothing and removes nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks, passages
from .suffix_dedup import spans


def solve(table: pa.Table, units: passages.Units) -> pa.RecordBatch:
    """For each string the runs of its windows with the smallest doc_id that holds them, where that can be another document's."""
    windows, owner, place = [], [], []
    d = [x if x is not None else np.iinfo(np.int64).max for x in table.column("d").to_pylist()]
    for i, (s, n) in enumerate(zip(table.column("s").to_pylist(), table.column("n").to_pylist(), strict=True)):
        windows += passages.windows(s, n, units)
        owner += [i] * n
        place += range(n)
    order = sorted(range(len(windows)), key=windows.__getitem__)
    least = [0] * len(windows)
    at = 0
    while at < len(order):
        to = at + 1
        first = windows[order[at]]
        while to < len(order) and windows[order[to]] == first:
            to += 1
        low = min(d[owner[k]] for k in order[at:to])
        for k in order[at:to]:
            least[k] = low
        at = to
    hs, ids, runs = table.column("h").to_pylist(), table.column("r").to_pylist(), [[] for _ in d]
    for k, i in enumerate(owner):
        if least[k] == d[i]:
            continue
        if runs[i] and runs[i][-1]["b"] == place[k] and runs[i][-1]["d"] == least[k]:
            runs[i][-1]["b"] = place[k] + 1
        else:
            runs[i].append({"a": place[k], "b": place[k] + 1, "d": least[k]})
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("d", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(ids, pa.int64()), pa.array(runs, kind)], names=["h", "r", "runs"])


def substring_dedup(docs: DataFrame, length: int = 50, anchor: int = 12, text: bool = False, owner: str = "query") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row; ``text`` adds the kept words joined by one space."""
    units = passages.Units(length, anchor, True)
    found = passages.ranges(docs, units, solve, True, owner)

    def finish(rows, data, offsets, cuts, flat):
        starts, ends, first = blocks.spans(data, offsets)
        held = data.tobytes()
        counts, gone, sums, left = [], [], [], []
        for i in range(rows.num_rows):
            a, b = int(first[i]), int(first[i + 1])
            keep = np.ones(b - a, bool)
            for x, y in spans(flat[cuts[i] : cuts[i + 1]], length).tolist():
                keep[x:y] = False
            kept = b" ".join([held[x:y] for x, y in zip(starts[a:b][keep].tolist(), ends[a:b][keep].tolist(), strict=True)])
            counts.append(b - a)
            gone.append(b - a - int(keep.sum()))
            sums.append(hashlib.sha256(kept).hexdigest())
            left.append(kept.decode("utf-8", "replace") if text else None)
        arrays = [rows.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string()), pa.array(left, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
        return pa.RecordBatch.from_arrays(arrays if text else arrays[:4], names=names if text else names[:4])

    shape = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * text
    return passages.apply(docs, found, finish, shape)
