"""Texts of Arrow batches as flat byte arrays, and the hashes of their words and byte windows.

Everything here works on a block of whole documents at once with numpy; a block is a slice of a batch that holds
about a megabyte of text, so memory stays bounded whatever the batch size (a longer document is a block of its own).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
#: Bytes of a word above which its hash is a cryptographic digest.
DIGEST_FROM = 64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of whole rows; a null text counts as empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        column = column.cast(pa.large_binary()) if column.null_count == 0 else column.fill_null(b"" if pa.types.is_binary(column.type) else "").cast(pa.large_binary())
        n = len(column)
        if not n:
            continue
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        held = column.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@lru_cache(4)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.ones(1 << bits, np.uint64)
    for k in range(bits):
        np.multiply(out[: 1 << k], np.uint64(pow(base, 1 << k, 1 << 64)), out=out[1 << k : 2 << k])
    return out


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of byte times power, and inverse powers: the hash of [a, b) is (s[b] - s[a]) * inverse[a]."""
    bits = max(16, int(len(data)).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, bits)[: len(data)], out=sums[1:])
    return sums, _powers(pow(_BASE, -1, 1 << 64), bits)


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all documents, runs of bytes that are not in ``gap`` (by default ``[^\\x20\\x09-\\x0D]+``), and the index of each document's first word (one more at the end)."""
    word = np.zeros(len(data) + 1, bool)
    np.logical_not(gap[data], out=word[:-1])
    first = word[:-1].copy()
    first[1:] &= ~word[:-2]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] |= word[heads]
    last = word[1:].copy()
    last[heads[heads > 0] - 1] = False
    last = word[:-1] & ~last
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; no other byte changes."""
    return _LOWER[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of the bytes of each word: a polynomial of its bytes, for which words of over DIGEST_FROM bytes could be made to collide whatever the base; those are digested."""
    sums, inverse = _sums(data)
    out = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > DIGEST_FROM).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def window_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Of the k bytes that start at each place, as far as k bytes follow."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    sums, inverse = _sums(data)
    return mix((sums[k:] - sums[:-k]) * inverse[: len(data) - k + 1])


def runs_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive values."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[i : i + m]
    return mix(out)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int, lower: bool = True) -> Iterator[np.ndarray]:
    """Each document's sorted distinct hashes of n consecutive words; of fewer words, one for all of them; of none, none."""
    data = lowered(data) if lower else data
    starts, ends, first = spans(data, offsets)
    words = word_hashes(data, starts, ends)
    grams = runs_of(words, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            got = np.sort(grams[a : b - n + 1])
            yield got[np.concatenate(([True], got[1:] != got[:-1]))]
        else:
            yield runs_of(words[a:b], b - a) if b > a else words[:0]


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive keys."""
    n = len(keys) - w + 1
    if n <= 0:
        return keys[:0]
    padded = np.full(-(-len(keys) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, w)
    fore = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], fore[w - 1 : w - 1 + n])


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column of the arrays."""
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(kind) if flat.dtype != np.uint64 else pa.array(flat.view(np.int64), kind))
