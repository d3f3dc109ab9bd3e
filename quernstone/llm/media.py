"""Media columns: texts as FLAC streams, read back as PCM blocks.

Defined cases: a null text is empty, and an empty payload is one block of spaces; equal texts have equal streams, so repeated
rows have equal values; a null doc_id is carried; a stream whose checksums fail raises flac.Corrupt; an empty table gives no rows;
columns other than doc_id and text (or media) are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks, flac


def _payloads(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Bytes up to a positive multiple of the block with spaces, as signed samples around 128."""
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        x = np.full(max(1, -(-(b - a) // flac.BLOCK)) * flac.BLOCK, 32, np.uint8)
        x[: b - a] = data[a:b]
        out.append((x ^ 0x80).view(np.int8))
    return out


def _features(x: np.ndarray) -> str:
    """Sum, energy, peak and zero crossings of the samples."""
    y = x.astype(np.int64)
    return f"sum={y.sum()};energy={(y * y).sum()};peak={np.abs(y).max()};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the FLAC stream (media) of each text."""

    def run(batches):
        for rows, data, offsets in blocks.blocks(batches, size=blocks.BLOCK_BYTES // 2):
            media = flac.encode(_payloads(data, offsets))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, samples: int = 4096) -> DataFrame:
    """doc_id, block, sample_offset, pcm (unsigned 8-bit) of each stream: any sample is found by its offset."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # one stream at a time bounds memory
                x = flac.decode([batch.column(1)[i].as_py()])[0].view(np.uint8) ^ 0x80
                at = range(0, len(x), samples)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * len(at), pa.int64()), pa.array(range(len(at)), pa.int32()), pa.array(at, pa.int64()), pa.array([x[a : a + samples].tobytes() for a in at], pa.binary())],
                    names=["doc_id", "block", "sample_offset", "pcm"],
                )

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, block int, sample_offset long, pcm binary")


def read_back(media: DataFrame) -> DataFrame:
    """The digest columns of stored streams, from what they decode to."""

    def run(batches):
        for rows, data, offsets in blocks.blocks(batches, "media", blocks.BLOCK_BYTES):
            held = data.tobytes()
            streams = [held[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            decoded = flac.decode(streams)
            raw = [(x.view(np.uint8) ^ 0x80).tobytes() for x in decoded]
            cols = (
                ([len(x) for x in raw], pa.int64()), ([hashlib.sha256(x).hexdigest() for x in raw], pa.string()), ([zlib.crc32(x[-16:]) for x in raw], pa.int64()),
                ([len(s) for s in streams], pa.int64()), ([hashlib.sha256(s).hexdigest() for s in streams], pa.string()), ([_features(x) for x in decoded], pa.string()),
            )
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(c, t) for c, t in cols)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    shape = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, shape)


def media_columns(docs: DataFrame) -> DataFrame:
    """Each text stored, read back and described."""
    return read_back(store(docs))
