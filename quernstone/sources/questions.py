"""Tables of questions, with the answers that are expected where they are for an evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "question string, ground_truth string"


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(qid, question, ground_truth) of a file of JSON lines, or of a text file with a question a line; qid counts its questions from 1, in order.

    A file of questions is a list that people wrote; it is read in one piece, which keeps its order. Blank questions are left out.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    said = lines.select("at", F.from_json("line", SCHEMA).alias("x")) if path.endswith((".jsonl", ".json")) else lines.select("at", F.struct(F.col("line").alias("question"), F.lit(None).cast("string").alias("ground_truth")).alias("x"))
    some = said.select("at", "x.*").where(F.trim(F.coalesce("question", F.lit(""))) != "")
    places = some.agg(F.array_sort(F.collect_list(F.struct("at", "question", "ground_truth"))).alias("every"))
    return places.select(F.posexplode("every").alias("qid", "x")).select((F.col("qid") + 1).cast("long").alias("qid"), F.trim("x.question").alias("question"), "x.ground_truth")
