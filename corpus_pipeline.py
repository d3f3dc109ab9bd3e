"""A corpus from raw documents to training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs; all but the last return the columns of documents. A stage deletes what the stage before it wrote to the shared folder
for its own use, as that stage's result is written by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import language, line_dedup, mixing, ngram_join, packing, scratch

OWNER = "pipeline"

#: Language ID, content-defined chunks, near-duplicate classes and Pareto samples are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter, or without a likely language, go."""
    scratch.release(spark, OWNER)
    return language.accepted(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that stand in an earlier document go."""
    scratch.release(spark, OWNER)
    return line_dedup.cleaned(docs, owner=OWNER)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: five-word shingles, similarity of 0.8 or more."""
    scratch.release(spark, OWNER)
    return ngram_join.one_of_each(docs, owner=OWNER)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    scratch.release(spark, OWNER)
    return mixing.rows(docs, owner=OWNER)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and their place in it."""
    scratch.release(spark, OWNER)
    return packing.pack(docs, owner=OWNER)


STAGES = [
    ("language_id", identify),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages make of the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name, "pipeline-run")
    return STAGES[-1][1](spark, docs, sf_dir)
