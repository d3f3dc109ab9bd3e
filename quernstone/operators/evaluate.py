"""Evaluation of answers: fixed questions, overlap metrics and their means."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")


def overlap(records: DataFrame, against: str = "ground_truth", text: str = "contexts_text") -> DataFrame:
    """Adds precision and recall of distinct words of ``text`` against ``against``. These are word overlaps, not a judge's
    scores, and are named so. Without words on a side its measure is null."""
    words = lambda c: F.array_distinct(tokens(F.lower(c)))
    shared = F.size(F.array_intersect(words(text), words(against)))
    rate = lambda c: F.when(F.size(words(c)) > 0, shared / F.size(words(c)))
    return records.withColumns({"overlap_precision": rate(text), "overlap_recall": rate(against)})


def means(scores: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(metric, mean, n) of the metrics that the table has; NaN and null do not count."""
    have = [m for m in metrics if m in scores.columns]
    rows = scores.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in have])).alias("x")).select("x.*")
    valid = F.when(~F.isnan("v"), F.col("v"))
    return rows.groupBy("metric").agg(F.avg(valid).alias("mean"), F.count(valid).alias("n"))


def records(graph, questions: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(qid, question, answer, contexts, ground_truth) of a graph's answers to ``questions`` (qid, question, ground_truth)."""
    got = graph.ask_with_contexts(questions.select("qid", "question"), fuzzy)
    return questions.join(got, "qid").select("qid", "question", "answer", "contexts", "ground_truth")


def run(graph, questions: DataFrame, path: str, score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Answers, scores and stores: JSON records under ``path``, and the means of the scores.

    ``score`` adds the METRICS to the records, as a judge would; the default adds word overlaps. If scoring fails, the
    records are stored as they are and the means are empty.
    """
    rows = records(graph, questions)
    score = score or (lambda df: overlap(df.withColumn("contexts_text", F.array_join("contexts", " "))).drop("contexts_text"))
    try:
        scored = score(rows)
        scored.write.mode("overwrite").json(path)
        return means(scored, (*METRICS, "overlap_precision", "overlap_recall"))
    except Exception:  # noqa: BLE001  a judge may fail in any way; answers are not lost with it
        rows.write.mode("overwrite").json(path)
        return means(rows.limit(0).withColumn(METRICS[0], F.lit(None).cast("double")))
