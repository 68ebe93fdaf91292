"""One object over a store and an index: build from sources, then look up, trace, search and assemble context."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import LOG, Settings
from .extract import base
from .functions import text as X
from .operators import chunking, context, graph, retrieval
from .plans.runtime import materialised
from .sources import files, logs, store

MAX_DEPTH, MOST_RESULTS = 5, 100  # of a trace asked for here; the operator has no bound of its own
ROUTES = ("health", "stats", "search", "context", "entity", "callers", "callees", "trace_calls", "impact", "query")


class Workspace:
    """Entities, relationships and chunks of a source tree or a loaded store."""

    path: str | None = None  # of the store it was loaded from
    scorer: Callable[[DataFrame, DataFrame, DataFrame, int], DataFrame] | None = None  # (hits, queries, chunks, limit) to (qid, id, score, rank)
    counter: X.Counter = X.RULE  # of tokens in contexts

    def __init__(self, spark: SparkSession, entities: DataFrame, relationships: DataFrame, chunks: DataFrame | None = None, vectors: DataFrame | None = None, settings: Settings | None = None, errors: DataFrame | None = None):
        self.spark, self.entities, self.relationships, self.chunks, self.vectors, self.errors = spark, entities, relationships, chunks, vectors, errors
        self.settings = settings or Settings()

    @classmethod
    def analyze(cls, spark: SparkSession, root: str, gitignore: str | None = None, ignore: tuple[str, ...] = (), history: str | None = None, coverage: str | None = None, settings: Settings | None = None) -> Workspace:
        """Scan, extract once, resolve references, add history and coverage, and index; ignores hold for graph and index alike."""
        settings = settings or Settings()
        found = files.scan(spark, root, gitignore, ignore)
        rows = materialised(files.extracted(found), "extract")
        e, r, errors = base.split(rows)
        e = graph.upsert(e)
        r = graph.resolve(r, e)
        if history and logs.missing(spark, history):
            errors = errors.union(logs.error_rows(spark, (history, "no exported git log there")))
        elif history:
            e, r = _merged(e, r, *logs.history_graph(logs.git_log(spark, history), root))
        if coverage:
            errors = errors.union(logs.cobertura_errors(spark, coverage))
            if not logs.missing(spark, coverage):
                e, r = _merged(e, r, *logs.cobertura(spark, coverage, root))
        chunks = materialised(chunking.chunk_code(e, found, settings.chunking), "chunks")
        return cls(spark, e, r, chunks, chunking.embed(chunks, settings.embedding.dimension), settings, errors)

    def save(self, path: str) -> None:
        about = store.manifest(self.settings.embedding.provider, self.settings.embedding.model, self.settings.embedding.dimension, self.settings.embedding.normalize, self.settings.chunking.max_chars, self.settings.chunking.overlap)
        store.save(self.entities, self.relationships, path, self.errors)
        if self.chunks is not None:
            store.save_index(self.chunks, self.vectors, about, f"{path}/index")

    @classmethod
    def load(cls, spark: SparkSession, path: str, settings: Settings | None = None) -> Workspace:
        e, r = store.load(spark, path)
        settings = settings or Settings()
        expected = {k: getattr(settings.embedding, k) for k in ("provider", "model", "dimension", "normalize")}
        try:
            chunks, vectors, _ = store.load_index(spark, f"{path}/index", expected)
        except ValueError as error:  # an index made with other settings: names are searched instead
            LOG.warning("%s", error)
            chunks = vectors = None
        made = cls(spark, e, r, chunks, vectors, settings, store.load_errors(spark, path))
        made.path = path
        return made

    def reload(self) -> Workspace:
        """Read a loaded store again, as another process may have written it; where it is gone, the tables stay."""
        if self.path and not logs.missing(self.spark, f"{self.path}/entities"):
            self.spark.catalog.refreshByPath(self.path)
            fresh = Workspace.load(self.spark, self.path, self.settings)
            self.entities, self.relationships, self.chunks, self.vectors, self.errors = fresh.entities, fresh.relationships, fresh.chunks, fresh.vectors, fresh.errors
        return self

    def tool(self, name: str, arguments: dict) -> str:
        """JSON of what a named tool answers; of an unknown tool, or one that fails, an object with ``error``."""
        try:
            return json.dumps(self._tool(name, dict(arguments)), indent=2, default=str)
        except Exception as error:  # noqa: BLE001  errors are answers here
            return json.dumps({"error": f"missing argument: {error}" if isinstance(error, KeyError) else str(error)})

    def _tool(self, name: str, given: dict) -> dict | list:
        def rows(df: DataFrame) -> list[dict]:
            return [r.asDict(recursive=True) for r in df.collect()]  # bounded by the tool's limit or budget

        if name == "search_codebase":
            return rows(self.search(given["query"], int(given.get("limit", 10))))
        if name == "get_entity_context":
            found = rows(self.context(given["entity_id"], given.get("task_type", "general"), int(given.get("max_tokens", 2000))))
            return found[0] if found else {"error": f"Entity not found: {given['entity_id']}"}
        if name == "trace_calls":
            return rows(self.trace_calls(given["entity_id"], given.get("direction", "callees"), int(given.get("depth", 1))))
        if name == "retrieve_context_for_query":
            task = given.get("task_type", "auto")
            return rows(self.query(given["query"], int(given.get("max_tokens", 6000)), None if task == "auto" else task, int(given.get("limit_entities", 3)), int(given.get("expand_deps", True))))[0]
        return {"error": f"Unknown tool: {name}"}

    # --- lookups and traversal

    def health(self) -> dict:
        return {"status": "ok"}

    def stats(self) -> DataFrame:
        return graph.stats(self.entities, self.relationships)

    def search(self, pattern: str, limit: int | None = 10) -> DataFrame:
        return graph.search(self.entities, pattern, limit).select("id", "kind", "name", "qualified_name", "file", "line")

    def entity(self, entity_id: str) -> DataFrame:
        return graph.get_entity(self.entities, entity_id)

    def callers(self, entity_id: str) -> DataFrame:
        return graph.callers(self.relationships, self.entities, entity_id).select("id", F.col("qualified_name").alias("name"), "file")

    def callees(self, entity_id: str) -> DataFrame:
        return graph.callees(self.relationships, self.entities, entity_id).select("id", F.col("qualified_name").alias("name"))

    def trace_calls(self, entity_id: str, direction: str = "callees", depth: int = 1, max_results: int = 50) -> DataFrame:
        return graph.trace_calls(self.relationships, self.entities, entity_id, direction, max(1, min(depth, MAX_DEPTH)), max(1, min(max_results, MOST_RESULTS)))

    def impact(self, entity_id: str, max_depth: int = 3) -> DataFrame:
        return graph.impact(self.relationships, self.entities, entity_id, max_depth)

    # --- retrieval and context

    def hits(self, question: str, limit: int = 10, now: str | None = None, depth: int = 1) -> DataFrame:
        """Chunks for a question: both legs, fused, reranked, with what they call ``depth`` hops on; the sparse leg alone where there are no vectors."""
        asked = self.spark.createDataFrame([(0, question)], "qid int, text string")
        found = retrieval.overlap_search(self.chunks, asked, 4 * limit)
        if self.vectors is not None:
            tokens = asked.select(F.col("qid").alias("id"), X.tokenize(F.col("text")).alias("tokens"))
            vector = chunking.embed(tokens, self.settings.embedding.dimension).select(F.col("id").alias("qid"), "embedding")
            dense = retrieval.knn(self.vectors.withColumn("ord", F.col("id")), vector, 4 * limit)
            found = retrieval.fuse(found, dense, 2 * limit)
        else:
            found = found.select("qid", "id", F.col("overlap").cast("double").alias("score"), "rank")
        best = self._reranked(found, asked, limit, now)
        calls = self.relationships.filter("kind = 'calls'")
        calls = calls.select("source_id", "target_id", "ord") if "ord" in calls.columns else calls.select("source_id", "target_id", F.lit(0).alias("ord"))
        return retrieval.expand(best, self.chunks, calls, depth)

    def _reranked(self, found: DataFrame, asked: DataFrame, limit: int, now: str | None) -> DataFrame:
        """By the scorer that is plugged in, else or if it fails by signals."""
        if self.scorer is not None:
            try:
                return materialised(self.scorer(found, asked, self.chunks, limit).select("qid", "id", "score", "rank"), "scored")
            except Exception as error:  # noqa: BLE001
                LOG.warning("the scorer failed, signals are used: %s", error)
        return retrieval.rerank(found, asked, self.chunks, limit, now)

    def context(self, target: str, task: str | None = None, budget: int = context.BUDGET) -> DataFrame:
        """Context of the entity a text names (by id, else the first match), by task or in fixed order; no rows if there is none."""
        return self._contexts(graph.resolve_target(self.entities, target).select("id"), task, budget)

    def summary(self, query: str, most: int = 5) -> DataFrame:
        return context.search_summary(graph.search(self.entities, query, most), query)

    def named(self, question: str, most: int) -> DataFrame:
        """qid, entity_id, rank: the first entities that the question's identifiers name, in the order of the question; what is left where there is no index or no hit."""
        words = self.spark.createDataFrame([(question,)], "q string").select(F.posexplode(X.keywords(F.col("q"))).alias("pos", "word"))
        meant = F.contains(F.lower("name"), F.lower("word")) | F.contains(F.lower("qualified_name"), F.lower("word"))
        found = self.entities.join(F.broadcast(words), meant).groupBy(F.col("id").alias("entity_id")).agg(F.min(F.struct("pos", "ord")).alias("at"))  # ten words at most
        first = found.orderBy("at", "entity_id").limit(most)
        rank = F.row_number().over(Window.orderBy("at", "entity_id"))
        return materialised(first.select(F.lit(0).alias("qid"), "entity_id", rank.alias("rank")), "named")

    def _contexts(self, ids: DataFrame, task: str | None, budget: int) -> DataFrame:
        wanted = self.entities.join(ids, "id", "left_semi")
        out = ids.select(F.col("id").alias("source_id"))
        into = self.relationships.join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(self.relationships.columns)
        edges = self.relationships.join(out, "source_id", "left_semi").union(into.join(out, "source_id", "left_anti").select(self.relationships.columns))
        parts = context.sections(self.entities, edges).join(wanted.select("id"), "id", "left_semi")
        if task is None:
            return context.synthesize_fixed(parts, budget, self.counter)
        return context.synthesize(parts, task if task in context.PRIORITIES else "general", budget, self.counter)

    def query(self, question: str, max_tokens: int = 6000, task: str | None = None, entities: int = 3, depth: int = 1) -> DataFrame:
        """One row: task, confidence, mode, text, tokens, sufficiency, truncated, where the answer should come from, the entities chosen and the evidence (all hits, in order)."""
        row = self.spark.createDataFrame([(question,)], "q string").select(X.classify(F.col("q")).alias("c")).select("c.*").first()
        chosen, sure = (task, 1.0) if task else (row["task"], row["confidence"])
        if max_tokens <= 0 or entities <= 0:
            return self.spark.createDataFrame([(chosen, sure, "none", "", 0, 0.0, False, "model", [], [])], _ANSWER)
        mode, ids = "semantic", None
        if self.chunks is not None:
            hits = materialised(self.hits(question, max(10, 5 * entities), depth=depth), "hits")
            ids = materialised(retrieval.distinct_entities(hits, entities), "chosen")
            proof = hits.select("rank", F.col("id").alias("chunk_id"), "entity_id", "score", "source")
        if ids is None or ids.isEmpty():
            mode, ids = "lexical", self.named(question, entities)
            proof = ids.select("rank", F.lit(None).cast("string").alias("chunk_id"), "entity_id", F.lit(None).cast("double").alias("score"), F.lit("lexical").alias("source"))
        each = max(200, min(2000, max_tokens // entities))
        made = self._contexts(ids.select(F.col("entity_id").alias("id")), chosen, each).join(ids.select(F.col("entity_id").alias("id"), "rank"), "id")
        whole = made.agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n---\n\n").alias("text"),
            F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
            F.coalesce(F.round(F.avg("sufficiency"), 2), F.lit(0.0)).alias("sufficiency"),
            F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"),
            F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("entity_id"), "tokens", "truncated", "sufficiency"))), lambda x: x.dropFields("rank")).alias("selected"),
        )
        evidence = proof.agg(F.array_sort(F.collect_list(F.struct(*proof.columns)))).scalar()
        answer = context.gate(F.col("sufficiency"), F.col("text"), threshold=self.settings.threshold)
        return whole.select(F.lit(chosen).alias("task"), F.lit(float(sure)).alias("confidence"), F.lit(mode).alias("mode"), "text", "tokens", "sufficiency", "truncated", answer.alias("answer_from"), "selected", evidence.alias("evidence"))


_ANSWER = "task string, confidence double, mode string, text string, tokens int, sufficiency double, truncated boolean, answer_from string, selected array<struct<entity_id:string,tokens:int,truncated:boolean,sufficiency:double>>, evidence array<struct<rank:int,chunk_id:string,entity_id:string,score:double,source:string>>"


def _merged(e: DataFrame, r: DataFrame, more_e: DataFrame, more_r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """History and coverage come after the sources' own rows in every order."""
    last = F.struct(F.lit("￿").alias("path"), F.lit(0).alias("seq"))
    both = e.unionByName(more_e.withColumn("ord", last), allowMissingColumns=True)
    return graph.upsert(both), r.unionByName(more_r.withColumn("ord", last), allowMissingColumns=True)
