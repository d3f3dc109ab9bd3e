"""String functions with the belief graph's semantics, as Spark columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP, SEARCH = 10_000, 500, 2_000
BREAK = "\n\n"
#: Characters of chunks that a task hands on at once.
SLICE = 1 << 20


def strip(x: Column) -> Column:
    """Without white space (any of Unicode) at both ends; trim() only knows the space."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def tokens(x: Column) -> Column:
    """Words between white space, none empty."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda t: t != "")


def clipped(x: Column, size: int) -> Column:
    """A label: at most ``size`` characters, the last three dots where it was longer."""
    return F.when(F.length(x) > size, F.concat(F.substring(x, 1, size - 3), F.lit("..."))).otherwise(x)


def or_unknown(x: Column, other: str = "?") -> Column:
    return F.coalesce(x, F.lit(other))


def citation(source: Column, entity: Column, claim: Column, confidence: Column) -> Column:
    """[source] entity: claim (confidence: ...), with ? for what is missing."""
    s, e, c, k = map(or_unknown, (source, entity, claim, confidence))
    return F.concat(F.lit("["), s, F.lit("] "), e, F.lit(": "), c, F.lit(" (confidence: "), k, F.lit(")"))


def windows(text: str, size: int = CHUNK, overlap: int = OVERLAP, search: int = SEARCH) -> Iterator[tuple[int, int]]:
    """[start, end) of the pieces of a long text. A piece ends at the last blank line that begins in its final
    ``search`` characters, if there is one; the next piece goes back by ``overlap``. A short text is one piece."""
    if len(text) <= size:
        yield 0, len(text)
        return
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            cut = text.rfind(BREAK, end - search, end)
            end = cut if cut >= 0 else end
        yield at, end
        at = end - overlap


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK, overlap: int = OVERLAP, search: int = SEARCH) -> DataFrame:
    """(id, chunk_idx, start_at, end_at, chunk) in Arrow batches, document by document.

    Chunks of a long text are stripped and blank ones are left out; a text that fits is one chunk as it is.
    The end may lie beyond the text: offsets are those of the unstripped walk. A task holds one batch as it came and about SLICE characters of texts and chunks
    (one document's, where that is longer), whatever the number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(0).type
            at, out, held = 0, ([], [], [], [], []), 0

            def made() -> pa.RecordBatch:
                ids = pc.take(batch.column(0), pa.array(out[0], pa.int64())).cast(kind)  # noqa: B023
                numbers = [pa.array(x, pa.int32()) for x in out[1:4]]  # noqa: B023
                return pa.RecordBatch.from_arrays([ids, *numbers, pa.array(out[4], pa.string())], names=[id_col, "chunk_idx", "start_at", "end_at", "chunk"])  # noqa: B023

            while at < batch.num_rows:
                text = batch.column(1)[at].as_py()
                if text is not None:
                    one, i = len(text) <= size, 0
                    for a, b in windows(text, size, overlap, search):
                        piece = text[a:b] if one else text[a:b].strip()
                        if piece or one:
                            for column, value in zip(out, (at, i, a, b, piece), strict=True):
                                column.append(value)
                            i, held = i + 1, held + len(piece)
                        if held >= SLICE:
                            yield made()
                            out, held = ([], [], [], [], []), 0
                at += 1
            if out[0]:
                yield made()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, chunk_idx int, start_at int, end_at int, chunk string")
