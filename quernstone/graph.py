"""The belief graph: ingestion, questions and reports over a versioned state.

Documents are resolved against earlier ones only, in order: one after the other, each in a commit that stores its entities, edges,
claims, contradictions, vectors and log row together (ingest), or all of a batch at once with the same result, in one commit (ingest_batch).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions.order import numbered, sums_before
from .functions.similarity import nearest
from .functions.vector_index import Cells, fit, in_cells, search
from .operators import batch, extract, graph, question
from .sources.documents import not_blank, not_ingested
from .sources.state import State, to_json
from .sources.working import Working

#: From a text column to a vector column, or an object with ``on_table`` (operators/ledger.py).
Embed = Callable[[Column], Column]


def embedded(rows: DataFrame, embed: Embed, text: str) -> DataFrame:
    """``rows`` with ``embedding`` of column ``text``."""
    return embed.on_table(rows, F.col(text), "embedding") if hasattr(embed, "on_table") else rows.withColumn("embedding", embed(F.col(text)))


def hashed_vector(text: Column, size: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed counts of hashed words and of their three-letter pieces."""
    words = T.tokens(F.lower(text))
    pieces = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substring(w, i, 3))))
    hashes = F.transform(F.concat(words, pieces), lambda x: F.xxhash64(x))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda d: F.aggregate(hashes, F.lit(0.0), lambda s, h: s + F.when(F.pmod(h, F.lit(size)) == d, F.when(h < 0, -1.0).otherwise(1.0)).otherwise(0.0)))


#: Tables of vectors that may have an index, with their number.
VECTORS = {"entity_vectors": "node_seq", "claim_vectors": "claim_seq"}


def searching(cells: Cells | None) -> Callable[..., DataFrame]:
    """nearest(), or where there is an index the search in it; stored vectors without a column ``cell`` get theirs."""
    if cells is None:
        return nearest

    def find(queries: DataFrame, stored: DataFrame, k: int, exclude_own_group: bool = False) -> DataFrame:
        return search(queries, stored if "cell" in stored.columns else in_cells(stored, cells), cells, k, exclude_own_group)

    return find


class BeliefGraph:
    def __init__(self, spark: SparkSession, path: str, extractor: Callable[[DataFrame], DataFrame] = extract.rules, embed: Embed = hashed_vector, classify: Callable[[DataFrame], DataFrame] = graph.default_classifier, answer: Callable[[DataFrame], DataFrame] = question.answers, threshold: float = graph.THRESHOLD, clock: Callable[[], str] | None = None):
        self.spark, self.state = spark, State(spark, path)
        self.extractor, self.embed, self.classify, self.answer, self.threshold = extractor, embed, classify, answer, threshold
        self.clock = clock or (lambda: datetime.now(UTC).isoformat())

    # reading

    def table(self, name: str) -> DataFrame:
        return self.state.tables()[name]

    def entities(self) -> DataFrame:
        """Names in code-point order."""
        return self.table("entities").select("name").orderBy("name")

    def claims_of(self, name: str) -> DataFrame:
        return graph.claims_of(self.table("claims"), name)

    def stats(self) -> DataFrame:
        t = self.state.tables()
        return graph.stats(reduce(DataFrame.unionByName, [t[k].select(F.lit(k).alias("kind")) for k in graph.COUNTED]))

    def contexts(self, questions: DataFrame, fuzzy: bool = True) -> DataFrame:
        t = self.state.tables()
        return question.contexts(questions, t["entities"], t["relationships"], t["claims"], t["contradictions"], fuzzy, Working(self.spark, f"{self.state.path}/asked"))

    def ask(self, questions: DataFrame, fuzzy: bool = True) -> DataFrame:
        """(qid, answer)."""
        return self.answer(self.contexts(questions, fuzzy))

    def ask_with_contexts(self, questions: DataFrame, fuzzy: bool = True) -> DataFrame:
        t = self.state.tables()
        return question.answer_contexts(questions, t["entities"], t["claims"], t["contradictions"], fuzzy, Working(self.spark, f"{self.state.path}/asked")).join(self.ask(questions, fuzzy), "qid")

    def export(self, label: str | None = None) -> str:
        return to_json(self.state.tables(), label, self.clock() if label else None).first()["json"]

    # tools: text in, text out

    def tool(self, name: str, argument: str = "") -> str:
        """The five read-only tools of a tool server; an unknown name is told, not raised."""
        asked = self.spark.createDataFrame([(argument, argument)], "qid string, question string")
        if name == "query_knowledge_graph":
            return self.ask(asked).first()["answer"]
        if name == "get_contradictions":
            rows = self.table("contradictions").select("con_seq", question.conflict_line().alias("line")).orderBy("con_seq").collect()  # a report is read by a person
            return "\n".join(f"{i}. {r['line']}" for i, r in enumerate(rows, 1)) or "No contradictions detected."
        if name == "get_entity_claims":
            t = self.state.tables()
            rows = question.lookup(asked.select(F.col("qid").alias("arg")), t["entities"], t["claims"]).orderBy("node_seq", "claim_seq").collect()
            if rows:
                return "\n".join(r["text"] for r in rows)
            like = [r["name"] for r in t["entities"].where(F.contains(F.lower("name"), F.lit(argument.lower()))).orderBy("node_seq").limit(10).collect()]
            return f"No claims for '{argument}'. Similar entities: {', '.join(like)}" if like else f"Entity '{argument}' not found."
        if name == "get_graph_stats":
            return self.stats().select(F.to_json(F.struct("*")).alias("j")).first()["j"]
        if name == "list_entities":
            names = [r["name"] for r in self.entities().collect()]
            return f"{len(names)} entities:\n" + "\n".join(names)
        return f"Unknown tool: {name}"

    # writing

    def reset(self) -> None:
        self.state.reset()

    def snapshot(self, label: str) -> None:
        self.state.snapshot(label, self.clock())

    def ingest(self, docs: DataFrame, check: bool = True, snapshots: bool = False) -> list[dict]:
        """Ingests (source_doc, text) in order of source_doc, one after the other, each in a commit of its own; returns a report for each.

        The input is read once and dealt to a folder for each document, so a document's turn reads only its own. Rows without a name are
        reported together, as skipped. For many documents at a time there is ingest_batch().
        """
        out, dealt = [], f"{self.state.path}/incoming/{uuid.uuid4().hex}"
        # folders are named by a digest: a file system's limit on names does not bind those of documents
        named = docs.select("source_doc", "text").withColumn("_doc", F.coalesce(F.sha2("source_doc", 256), F.lit("none")))
        named.repartition("_doc").write.partitionBy("_doc").parquet(dealt)
        held = self.spark.read.schema("source_doc string, text string, _doc string").parquet(dealt)
        try:
            for i, row in enumerate(held.select("source_doc", "_doc").distinct().orderBy("source_doc").toLocalIterator()):
                source = row["source_doc"]
                if source is None:
                    out.append(self._report(None) | {"reason": "no name"})
                    continue
                one = held.where(F.col("_doc") == row["_doc"]).select("source_doc", "text")
                out.append(self.ingest_one(one, source, check))
                if snapshots:
                    self.snapshot(f"{i:02d}_{source.rpartition('.')[0] or source}")
        finally:
            self.state.remove(dealt)
        return out

    def index_vectors(self, **how) -> dict[str, tuple[int, int] | None]:
        """Gives the stored vectors an index, which later commits add to and later ingestion searches; returns each table's number of cells and of probes.

        The vectors are written anew, in order of their cells; None: too few vectors for an index, which then are searched exactly, as all are without one. ``how``: as for vector_index.fit().
        """
        base = self.state.version()
        t, now = self.state.tables(), self.clock()
        new, rows, told = {}, [], {}
        for kind, seq in VECTORS.items():
            cells = fit(t[kind].select(F.col(seq).alias("seq"), F.col("embedding").alias("vec")), **how)
            new[kind] = in_cells(t[kind].drop("cell"), cells, "embedding").repartition("cell").sortWithinPartitions("cell")
            rows += [] if cells is None else [(kind, i, cells.probes, c.tolist()) for i, c in enumerate(cells.centroids)]
            told[kind] = cells and (len(cells.centroids), cells.probes)
        new["centroids"] = self.spark.createDataFrame(rows, t["centroids"].schema)  # at most vector_index.CELLS a table
        self.state.commit(new, replaced=tuple(new), base=base, time=now)
        return told

    def _cells(self, t: dict[str, DataFrame], kind: str) -> Cells | None:
        rows = sorted(t["centroids"].where(F.col("kind") == kind).collect(), key=lambda r: r["cell"])
        return Cells(np.array([r["vec"] for r in rows]), rows[0]["probes"]) if rows else None

    @staticmethod
    def _report(source: str | None) -> dict:
        return {"source": source, "entities_extracted": 0, "claims_extracted": 0, "relationships_extracted": 0, "conflicts_detected": 0, "skipped": True, "reason": None}

    def _last(self, t: dict[str, DataFrame]) -> dict[str, int]:
        """The highest sequence number of each table, -1 where it is empty."""
        return {k: t[k].agg(F.coalesce(F.max(c), F.lit(-1))).first()[0] for k, c in (("entities", "node_seq"), ("relationships", "edge_seq"), ("claims", "claim_seq"), ("contradictions", "con_seq"))}

    @contextmanager
    def _working(self) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
        """A function that writes a table and reads it back: read several times, it is made once, and lost executors don't undo it (models may be asked for it)."""
        made: list[str] = []

        def kept(df: DataFrame, name: str) -> DataFrame:
            path = f"{self.state.path}/working/{uuid.uuid4().hex}-{name}"
            df.write.parquet(path)
            made.append(path)
            return self.spark.read.schema(df.schema).parquet(path)

        try:
            yield kept
        finally:
            for path in made:
                self.state.remove(path)

    def ingest_one(self, doc: DataFrame, source: str, check: bool = True) -> dict:
        """Ingests the rows of one document. Only what it adds or changes is written."""
        base = self.state.version()
        now, t = self.clock(), self.state.tables()
        report = self._report(source)
        if not t["ingest_log"].where((F.col("source") == source) & ~F.col("skipped")).isEmpty():
            return report | {"reason": "already ingested"}
        readable = not_blank(doc)
        if readable.isEmpty():
            return report | {"reason": "blank"}
        with self._working() as kept:
            return self._ingested(readable, source, check, now, t, report, kept, base)

    def _ingested(self, readable: DataFrame, source: str, check: bool, now: str, t: dict[str, DataFrame], report: dict, kept: Callable[[DataFrame, str], DataFrame], base: str | None) -> dict:
        found = kept(self.extractor(T.chunks(readable, "source_doc")), "found")
        # each name is sent to the embedding model once, whatever reads its vector
        names = kept(embedded(extract.distinct_entities(extract.items(found, "entities")), self.embed, "name"), "entities")
        claims = extract.distinct_claims(extract.items(found, "claims"))
        edges = extract.distinct_relationships(extract.items(found, "relationships"))
        counts = {"entities_extracted": names.count(), "claims_extracted": claims.count(), "relationships_extracted": edges.count()}
        if not counts["entities_extracted"] and not counts["claims_extracted"]:
            return report | {"reason": "nothing extracted"}
        last = self._last(t)
        # one document's rows are numbered together
        seq = lambda k, *order, after=0: F.lit(last[k] + after).cast("long") + F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
        cells = {kind: self._cells(t, kind) for kind in VECTORS}
        resolved = kept(graph.resolve(names.select("name", "embedding"), t["entities"], t["entity_vectors"], self.threshold, searching(cells["entity_vectors"])), "resolved")
        # entities: those that the document names, merged with what is stored of them
        incoming = names.join(resolved.select("name", "canonical"), "name").withColumn("node_seq", seq("entities", "chunk_idx", "pos"))
        touched = t["entities"].join(incoming.select(F.col("canonical").alias("name")).distinct(), "name", "left_semi")
        nodes = kept(graph.upsert_nodes(touched.select(*t["entities"].columns), incoming), "nodes")
        others = t["entities"].join(nodes.select("name"), "name", "left_anti")
        every = others.select(*nodes.columns).unionByName(nodes)
        # edges: the pairs of the document, with what is stored of them
        new_edges = graph.resolve_ends(graph.remap(edges, resolved, "source", "target"), every).withColumn("edge_seq", seq("relationships", "chunk_idx", "pos"))
        cols = ["source", "target", "edge_seq", "relation"]
        before = t["relationships"].join(new_edges.select("source", "target").distinct(), ["source", "target"], "left_semi")
        links = kept(graph.upsert_edges(before.select(*cols).unionByName(new_edges.select(*cols))), "links")
        bare = graph.bare_nodes(links, every)
        number = seq("entities", "first_edge", "first_end", after=counts["entities_extracted"])
        bare = bare.select(number.alias("node_seq"), "name", F.lit(None).cast("string").alias("type"), F.array().cast("array<string>").alias("aliases"))
        told = self._told(claims, resolved, now).withColumn("claim_seq", seq("claims", "chunk_idx", "pos"))
        told = kept(told, "told")
        new = {"entities": nodes.unionByName(bare.select(*nodes.columns)), "relationships": links, "claims": told.select(*t["claims"].columns)}
        if check:
            conflicts = kept(self._conflicts(told, t, now, kept, cells["claim_vectors"]).withColumn("con_seq", seq("contradictions", "batch_id", "pos")), "conflicts")
            new["contradictions"] = conflicts.select(*t["contradictions"].columns)
            report |= {"conflicts_detected": conflicts.count()}
        # what could not be embedded is stored without a vector
        fresh = resolved.where("how = 'new'").select("name").join(incoming.select("name", "node_seq", "embedding"), "name").where("embedding is not null")
        new["entity_vectors"] = in_cells(fresh, cells["entity_vectors"], "embedding").select(*t["entity_vectors"].columns)
        new["claim_vectors"] = self._claim_vectors(told, cells["claim_vectors"])
        report |= counts | {"skipped": False}
        new["ingest_log"] = self.spark.createDataFrame([report], t["ingest_log"].schema)
        self.state.commit(new, base=base, source=source, time=now)
        return report

    def _told(self, claims: DataFrame, resolved: DataFrame, now: str, *same: str) -> DataFrame:
        """Claims as they are stored, with their vectors. An entity that only differs in case from a kept one follows it; ``same``: columns that a claim and its document's names (resolved) share."""
        folded = resolved.groupBy(*same, F.lower("name").alias("_l")).agg(F.min("canonical").alias("_c"))
        told = claims.withColumn("_l", F.lower("entity")).join(folded, [*same, "_l"], "left").withColumn("entity", F.coalesce("_c", "entity")).drop("_l", "_c")
        ids = F.sha2(F.concat_ws("\x1f", "source_doc", "entity", "claim"), 256)
        return embedded(told.withColumns({"id": ids, "ingested_at": F.lit(now)}), self.embed, "claim")

    @staticmethod
    def _claim_vectors(told: DataFrame, cells: Cells | None) -> DataFrame:
        rows = told.select("claim_seq", "id", "entity", "source_doc", F.substring("claim", 1, 500).alias("claim_text"), "embedding").where("embedding is not null")
        return in_cells(rows, cells, "embedding")

    def ingest_batch(self, docs: DataFrame, check: bool = True, snapshot: str | None = None) -> DataFrame:
        """Ingests all documents of (source_doc, text) at once, in one commit: the graph is the one that ingest() makes of them one after the other.

        Returns their rows of the log. Documents that are ingested already, blank, without a name or without an entity or a claim are left out of both.
        All steps are set-parallel; their number grows with the longest chain of changes in resolution (operators/batch.py), not with the documents.
        ``snapshot``: a label under which the version is kept.
        """
        base = self.state.version()
        now, t = self.clock(), self.state.tables()
        done = t["ingest_log"].where("not skipped").select(F.col("source").alias("source_doc"))
        with self._working() as kept:
            log = self._batch(not_ingested(not_blank(docs.where("source_doc is not null").select("source_doc", "text")), done), check, now, t, kept, base)
            if snapshot is not None:
                self.snapshot(snapshot)
        return self.table("ingest_log").join(log, "source", "left_semi") if log is not None else t["ingest_log"].limit(0)

    def _batch(self, readable: DataFrame, check: bool, now: str, t: dict[str, DataFrame], kept: Callable[[DataFrame, str], DataFrame], version: str | None) -> DataFrame | None:
        found = kept(self.extractor(T.chunks(readable, "source_doc")), "found")
        sources = kept(numbered(extract.worth_keeping(found), "source_doc", kept), "sources")
        if sources.isEmpty():
            return None
        last = self._last(t)
        placed = lambda rows: rows.join(sources, "source_doc").withColumn("n", F.row_number().over(Window.partitionBy("source_doc").orderBy("chunk_idx", "pos")).cast("long"))
        names = kept(placed(extract.distinct_entities(extract.items(found, "entities"))), "entities")
        # a name that several documents have is sent to the embedding model once
        vectors = kept(embedded(names.select("name").distinct(), self.embed, "name"), "vectors")
        names = kept(names.join(vectors, "name"), "embedded")
        edges = kept(placed(extract.distinct_relationships(extract.items(found, "relationships"))), "edges")
        cells = {kind: self._cells(t, kind) for kind in VECTORS}
        got = batch.resolve_batch(names, edges, t["entities"], kept, t["entity_vectors"], self.threshold, searching(cells["entity_vectors"]))
        # nodes: numbers go on where those of the document before end; a document ends at its last new node
        made = got.names.where("how = 'new'").select("k", "n").unionByName(got.bare.select("k", "n"))
        base = self._bases(sources, made, last["entities"])
        incoming = got.names.join(base, "k").withColumn("node_seq", F.col("base") + F.col("n"))
        bare = got.bare.join(base, "k").select((F.col("base") + F.col("n")).alias("node_seq"), F.col("name").alias("canonical"), "name", F.lit(None).cast("string").alias("type"), F.array().cast("array<string>").alias("aliases"))
        cols = ["node_seq", "canonical", "name", "type", "aliases"]
        touched = t["entities"].join(incoming.select(F.col("canonical").alias("name")).distinct(), "name", "left_semi")
        nodes = kept(graph.upsert_nodes(touched.select(*t["entities"].columns), incoming.select(*cols).unionByName(bare.select(*cols))), "nodes")
        # edges: a pair's number is that of its first, its relation that of its last
        place = F.struct("k", "n")
        pairs = kept(got.edges.groupBy("source", "target").agg(F.min(place).alias("first"), F.max_by("relation", place).alias("relation")), "pairs")
        stored = t["relationships"].select("source", "target", F.col("edge_seq").alias("stored"))
        pairs = pairs.join(stored, ["source", "target"], "left")
        base = self._bases(sources, pairs.where("stored is null").select("first.k", "first.n"), last["relationships"])
        links = pairs.join(base, F.col("first.k") == F.col("k")).select("source", "target", F.coalesce("stored", F.col("base") + F.col("first.n")).alias("edge_seq"), "relation")
        # claims
        claims = placed(extract.distinct_claims(extract.items(found, "claims")))
        base = self._bases(sources, claims.select("k", "n"), last["claims"])
        told = self._told(claims, got.names.select("source_doc", "name", "canonical"), now, "source_doc")
        told = kept(told.join(base, "k").withColumn("claim_seq", F.col("base") + F.col("n")).drop("base"), "told")
        new = {"entities": nodes, "relationships": links, "claims": told.select(*t["claims"].columns)}
        conflicts = None
        if check:
            rows = self._conflicts(told.withColumn("at", F.col("k")), self._with_batch(t, told, cells["claim_vectors"]), now, kept, cells["claim_vectors"]).join(sources, "source_doc")
            rows = kept(rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("batch_id", "pos")).cast("long")), "conflicts")
            base = self._bases(sources, rows.select("k", "n"), last["contradictions"])
            new["contradictions"] = rows.join(base, "k").withColumn("con_seq", F.col("base") + F.col("n")).select(*t["contradictions"].columns)
            conflicts = rows
        fresh = incoming.where("how = 'new' and embedding is not null")
        new["entity_vectors"] = in_cells(fresh, cells["entity_vectors"], "embedding").select(*t["entity_vectors"].columns)
        new["claim_vectors"] = self._claim_vectors(told, cells["claim_vectors"])
        log = sources.select("k", F.col("source_doc").alias("source"))
        for name, rows in (("entities_extracted", names), ("claims_extracted", told), ("relationships_extracted", edges), ("conflicts_detected", conflicts)):
            counted = rows.groupBy("k").agg(F.count("*").alias(name)) if rows is not None else sources.select("k", F.lit(0).alias(name))
            log = log.join(counted, "k", "left").withColumn(name, F.coalesce(name, F.lit(0)))
        new["ingest_log"] = log.withColumns({"skipped": F.lit(False), "reason": F.lit(None).cast("string")})
        self.state.commit(new, base=version, time=now)
        return self.spark.read.schema("source string").parquet(f"{self.state.path}/parts/{self.state.version()}/ingest_log")

    @staticmethod
    def _bases(sources: DataFrame, used: DataFrame, last: int) -> DataFrame:
        """(k, base): the number after which document k's rows (``used``: k, n) are numbered, each document using up as many as its largest n."""
        most = used.groupBy("k").agg(F.max("n").alias("n"))
        return sums_before(sources.select("k").join(most, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n")), "k", "n", "base", last)

    @staticmethod
    def _with_batch(t: dict[str, DataFrame], told: DataFrame, cells: Cells | None) -> dict[str, DataFrame]:
        """The stored claims and vectors with those of a batch, which are there from document ``at`` on."""
        vectors = BeliefGraph._claim_vectors(told, cells).join(told.select("claim_seq", F.col("k").alias("at")), "claim_seq")
        both = t["claim_vectors"].withColumn("at", F.lit(-1).cast("long")).unionByName(vectors.select(*t["claim_vectors"].columns, "at"))
        return t | {"claims": t["claims"].unionByName(told.select(*t["claims"].columns)), "claim_vectors": both}

    def _conflicts(self, told: DataFrame, t: dict[str, DataFrame], now: str, kept: Callable[[DataFrame, str], DataFrame], cells: Cells | None) -> DataFrame:
        """Contradictions and refinements between a document's claims and the nearest stored ones of earlier documents.

        Hits lead to the earliest claim with their text and entity; new claims go to the classifier BATCH at a time, each batch with all
        candidates of its claims; valid verdicts are joined back by their numbers. Claims without a vector are not checked. Where both tables
        have ``at``, only claims of a smaller one are candidates.
        """
        asked = told.where("embedding is not null").withColumn("q", F.col("claim_seq"))
        hits = graph.similar_claims(asked.select("q", "source_doc", "embedding", *[c for c in ("at",) if c in told.columns]), t["claim_vectors"], search=searching(cells))
        meant = hits.join(t["claim_vectors"].select(F.col("claim_seq").alias("seq"), "claim_text", "entity"), "seq")
        found = graph.hit_to_claim(meant, t["claims"]).select("q", "rank", "claim_seq")
        new = told.select(F.col("claim_seq").alias("q"), "source_doc", F.col("entity").alias("new_entity"), F.col("claim").alias("new_claim"))
        old = t["claims"].select("claim_seq", "entity", "claim", F.col("source_doc").alias("existing_source"))
        numbered = kept(graph.batches(found.join(old, "claim_seq").join(new, "q").withColumnRenamed("q", "new_idx")), "pairs")
        asked = graph.batch_questions(numbered)
        replies = kept(self.classify(asked).select("source_doc", "batch_id", "n_new", "n_existing", "reply"), "replies")
        verdicts = graph.valid_verdicts(replies, replies.select("source_doc", "batch_id", "n_new", "n_existing"))
        rows = graph.verdict_claims(verdicts, numbered, "claim_seq")
        fields = ("entity", "claim", "confidence", "source_doc", "ingested_at", "id")
        one = lambda df, key, name: df.select(F.col("claim_seq").alias(key), F.struct(*fields).alias(name))
        rows = rows.join(one(t["claims"], "claim_seq", "existing_claim"), "claim_seq").join(one(told, "new_idx", "new_claim"), "new_idx")
        return rows.select("source_doc", "batch_id", "pos", "existing_claim", "new_claim", "relation", "explanation", F.lit(now).alias("detected_at"))
