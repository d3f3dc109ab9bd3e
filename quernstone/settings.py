"""What a deployment sets once: where the graph is and how it resolves, from a session's configuration."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from .graph import BeliefGraph
from .operators.graph import THRESHOLD

PREFIX = "spark.quernstone."


@dataclass(frozen=True)
class Settings:
    """``state``: the graph's folder; ``threshold``: similarity from which a name joins a node; ``ledger``: the folder of model replies; the models' names are for what connects to them."""

    state: str
    threshold: float = THRESHOLD
    ledger: str | None = None
    chat_model: str | None = None
    embedding_model: str | None = None

    @classmethod
    def of(cls, spark: SparkSession, **given) -> Settings:
        """Each field from ``given``, else from the session's ``spark.quernstone.<field>``, else its default; ``state`` has none."""
        found = {f.name: v for f in fields(cls) if (v := spark.conf.get(PREFIX + f.name, None)) is not None} | given
        if not found.get("state"):
            raise ValueError(f"{PREFIX}state is unset: it names the graph's folder")
        return cls(**found | {"threshold": float(found.get("threshold", THRESHOLD))})

    def graph(self, spark: SparkSession, **how) -> BeliefGraph:
        """The graph of these settings; ``how``: the models, as for BeliefGraph."""
        return BeliefGraph(spark, self.state, threshold=self.threshold, **how)
