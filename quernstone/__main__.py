"""python -m quernstone STATE [--documents FOLDER] [--questions FILE] [--interactive] [--page FILE]

Ingests a folder's documents into the graph at STATE with a snapshot each, answers the questions of a file (one a line),
then those typed in, and writes the graph as a page.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .graph import BeliefGraph
from .operators import report
from .sources.documents import scan

QUIT = {"quit", "exit", "q"}


def place(path: str) -> str:
    return path if "://" in path else "file://" + os.path.abspath(path)


def main(args: list[str] | None = None, spark: SparkSession | None = None, lines=sys.stdin) -> int:
    parser = argparse.ArgumentParser(prog="quernstone", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("state")
    for name in ("--documents", "--questions", "--page"):
        parser.add_argument(name)
    parser.add_argument("--interactive", action="store_true")
    got = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("quernstone").getOrCreate()
    graph = BeliefGraph(spark, place(got.state))

    def answer(text: str) -> None:
        print(graph.tool("query_knowledge_graph", text))

    if got.documents:
        found = scan(spark, place(got.documents))
        if found.isEmpty():
            print(f"No .txt, .pdf or .md files in {got.documents}")
            return 1
        for r in graph.ingest(found, snapshots=True):
            print(f"{r['source']}: " + (f"skipped ({r['reason']})" if r["skipped"] else f"{r['entities_extracted']} entities, {r['claims_extracted']} claims, {r['relationships_extracted']} relationships, {r['conflicts_detected']} conflicts"))
    print(graph.tool("get_graph_stats"))
    if got.questions:
        with open(got.questions, encoding="utf-8") as f:
            for q in filter(None, map(str.strip, f)):
                print(f"> {q}")
                answer(q)
    if got.interactive:
        for q in map(str.strip, lines):
            if q.lower() in QUIT:
                break
            if q:
                answer(q)
    if got.page:
        with open(got.page, "w", encoding="utf-8") as f:
            f.write(report.page(graph.state.tables()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
