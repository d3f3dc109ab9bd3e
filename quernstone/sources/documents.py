"""Documents from a folder of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.schemas import SUFFIXES


def scan(spark: SparkSession, folder: str, pdf: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(path, source_doc, text) of the folder's .txt, .md and .pdf files, whatever the suffix's case; not its subfolders.

    Order is that of ``path``. Text files must be UTF-8, else the read fails. ``pdf`` turns a file into its pages' texts (a page
    without text is empty); without it, reading a folder that has such files raises.
    """
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    files = spark.read.format("binaryFile").load(folder).select("path", "content", suffix.alias("suffix")).where(F.col("suffix").isin(*SUFFIXES))
    named = files.withColumn("source_doc", F.element_at(F.split("path", "/"), -1))
    plain = named.where("suffix <> '.pdf'").select("path", "source_doc", F.decode("content", "UTF-8").alias("text"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows) and pdf is None:
                raise RuntimeError("PDF files need a reader: pass pdf=, a function from bytes to the pages' texts")
            yield pd.DataFrame({"path": rows["path"], "source_doc": rows["source_doc"], "text": ["\n".join(x or "" for x in pdf(c)) for c in rows["content"]] if len(rows) else []})

    pages = named.where("suffix = '.pdf'").select("path", "source_doc", "content").mapInPandas(read, "path string, source_doc string, text string")
    return plain.unionByName(pages)


def not_blank(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.where(strip(F.col(text)) != "")


def not_ingested(docs: DataFrame, done: DataFrame, key: str = "source_doc") -> DataFrame:
    """Documents whose source is not in ``done``."""
    return docs.join(done.select(key).distinct(), key, "left_anti")
