"""Queries of chunking, search, fusion, reranking, evaluation and context assembly.

Benchmark passages are the questions: their text for the sparse leg and the vector of the
same number for the dense one. Chunks are windows of the documents; a document's vector
stands for its first window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import context, retrieval
from .text_queries import words_sql
from .views import chunk_documents, table

QUERIES: dict = {}
LIMIT = 10


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def chunks(spark: SparkSession, d: str) -> DataFrame:
    c = retrieval.chunk(chunk_documents(spark, d))
    return c.withColumn("ord", F.col("ord") * 100_000 + F.col("chunk_index"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def dense_questions(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return table(spark, d, "benchmark").join(v, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("qid"), "embedding")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.concat(F.lit("doc::"), F.col("vec_id").cast("string"), F.lit("::0")).alias("id"), "embedding", F.col("vec_id").alias("ord"))


def sparse(spark: SparkSession, d: str, limit: int = 4 * LIMIT) -> DataFrame:
    return retrieval.overlap_search(chunks(spark, d), questions(spark, d), limit)


def dense(spark: SparkSession, d: str, limit: int = 4 * LIMIT) -> DataFrame:
    known = chunks(spark, d).filter("chunk_index = 0").select("id")
    return retrieval.knn(vectors(spark, d), dense_questions(spark, d), limit).join(known, "id", "left_semi")  # cut first, then drop unknown chunks


def hybrid(spark: SparkSession, d: str, limit: int = 2 * LIMIT) -> DataFrame:
    return retrieval.fuse(sparse(spark, d), dense(spark, d), limit)


_CHUNKS = """WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1),
 doc AS (SELECT 'doc::'||doc_id AS entity_id, coalesce(text, '') AS content, lang AS kind, CASE WHEN quality = 1 THEN 'true' ELSE 'false' END AS has_docstring, doc_id AS dord, length(coalesce(text, '')) AS n FROM documents LEFT JOIN q USING (doc_id)),
 chunk AS (SELECT entity_id||'::'||i AS id, entity_id, i AS chunk_index, substr(content, (i * 900 + 1)::BIGINT, 1000) AS content, kind, has_docstring, dord * 100000 + i AS ord FROM doc, generate_series(0, 100000) g(i) WHERE i < CASE WHEN n <= 1000 THEN 1 ELSE ceil((n - 1000) / 900)::BIGINT + 1 END)"""
_CHUNKS = _CHUNKS.replace("FROM doc, generate_series(0, 100000) g(i) WHERE i < CASE WHEN n <= 1000 THEN 1 ELSE ceil((n - 1000) / 900)::BIGINT + 1 END)", "FROM (SELECT *, unnest(range(CASE WHEN n <= 1000 THEN 1 ELSE ceil((n - 1000) / 900)::BIGINT + 1 END)) AS i FROM doc))")
_SPARSE = f""", p AS (SELECT id, ord, unnest(list_distinct({words_sql('content')})) AS token FROM chunk),
 a AS (SELECT item_id AS qid, unnest(list_distinct({words_sql('text')})) AS token FROM benchmark),
 so AS (SELECT qid, id, count(*) AS overlap, min(ord) AS ord FROM p JOIN a USING (token) GROUP BY 1, 2),
 sr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, ord, id) AS rank FROM so), sparse AS (SELECT * FROM sr WHERE rank <= 40)"""
_KNN = """, dv AS (SELECT item_id AS qid, embedding::DOUBLE[] AS a FROM benchmark JOIN embeddings ON item_id = vec_id),
 ds AS (SELECT qid, 'doc::'||vec_id||'::0' AS id, vec_id AS ord, round(list_dot_product(embedding::DOUBLE[], a), 9) AS score FROM embeddings, dv),
 dr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS rank FROM ds), dense AS (SELECT * FROM dr WHERE rank <= 40 AND id IN (SELECT id FROM chunk WHERE chunk_index = 0))"""
_FUSE = """, parts AS (SELECT qid, id, 0.5::DOUBLE / (60 + rank) AS part, rank AS s, NULL::BIGINT AS d FROM sparse UNION ALL SELECT qid, id, 0.5::DOUBLE / (60 + rank), NULL, rank FROM dense),
 fs AS (SELECT qid, id, sum(part) AS score, min(s) AS s, min(d) AS d FROM parts GROUP BY 1, 2),
 fr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, s NULLS LAST, d NULLS LAST) AS rank FROM fs), hybrid AS (SELECT * FROM fr WHERE rank <= 20)"""
_RERANK = """, rs AS (SELECT qid, h.id, h.score * CASE WHEN c.has_docstring = 'true' THEN 1.2 ELSE 1.0 END * CASE WHEN contains(lower(c.content), lower(b.text)) THEN 1.5 ELSE 1.0 END * CASE WHEN lower(b.text) = lower(c.kind) THEN 2.0 ELSE 1.0 END AS score, h.rank AS before
 FROM hybrid h JOIN benchmark b ON b.item_id = h.qid JOIN chunk c ON c.id = h.id), rr AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, before) AS rank FROM rs), reranked AS (SELECT * FROM rr WHERE rank <= 10)"""


@query(f"{_CHUNKS} SELECT id, entity_id, chunk_index, content FROM chunk")
def chunk_windows(spark, d):
    return chunks(spark, d).select("id", "entity_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content")


@query(f"{_CHUNKS} SELECT kind, count(*) AS n_chunks, count(DISTINCT entity_id) AS n_entities, sum(length(content))::BIGINT AS n_chars FROM chunk GROUP BY kind")
def chunk_counts(spark, d):
    c = chunks(spark, d)
    per = c.groupBy("kind", "entity_id").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))
    return per.groupBy("kind").agg(F.sum("n").alias("n_chunks"), F.count("*").alias("n_entities"), F.sum("chars").alias("n_chars"))


@query("""SELECT vec_id, round(list_dot_product(v, v), 6) AS norm, array_to_string(list_transform(v[1:4], lambda x: x::DECIMAL(10,6)), ',') AS head FROM
 (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)""")
def normalize_vectors(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", X.normalize(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(X.dot(F.col("v"), F.col("v")), 6).alias("norm"), F.array_join(F.transform(F.slice("v", 1, 4), lambda x: x.cast("decimal(10,6)").cast("string")), ",").alias("head"))


@query("SELECT 'doc::'||b.vec_id||'::0' AS id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY score DESC, b.vec_id LIMIT 10")
def knn_single(spark, d):
    one = table(spark, d, "embeddings").filter("vec_id = 0").select(F.lit(0).alias("qid"), "embedding")
    return retrieval.knn(vectors(spark, d), one, LIMIT).select("id", "score")


@query(f"{_CHUNKS}{_KNN} SELECT qid, id, score, rank FROM dr WHERE rank <= 10")
def knn_batch(spark, d):
    return retrieval.knn(vectors(spark, d), dense_questions(spark, d), LIMIT)


@query(f"{_CHUNKS}{_SPARSE} SELECT qid, id, overlap, rank FROM sparse")
def token_overlap_topk(spark, d):
    return sparse(spark, d)


@query(f"{_CHUNKS}{_SPARSE}{_KNN}{_FUSE} SELECT qid, id, round(score, 9) AS score, rank FROM hybrid")
def rrf_hybrid(spark, d):
    return hybrid(spark, d).select("qid", "id", F.round("score", 9).alias("score"), "rank")


def reranked(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rerank(hybrid(spark, d), questions(spark, d), chunks(spark, d), LIMIT)


@query(f"{_CHUNKS}{_SPARSE}{_KNN}{_FUSE}{_RERANK} SELECT qid, id, round(score, 9) AS score, rank FROM reranked")
def rerank_signals(spark, d):
    return reranked(spark, d).select("qid", "id", F.round("score", 9).alias("score"), "rank")


def _calls(spark, d):
    """A document calls the document after it."""
    docs = table(spark, d, "documents")
    return docs.select(F.concat(F.lit("doc::"), F.col("doc_id").cast("string")).alias("source_id"), F.concat(F.lit("doc::"), (F.col("doc_id") + 1).cast("string")).alias("target_id"), F.col("doc_id").alias("ord"))


def _expand_sql(depth: int) -> str:
    return f"""{_CHUNKS}{_SPARSE}{_KNN}{_FUSE}{_RERANK}, hit AS (SELECT r.*, c.entity_id, c.ord FROM reranked r JOIN chunk c USING (id)),
 x AS (SELECT qid, id, entity_id, score, 'retrieved' AS source, rank AS hit, 0 AS pos, 0::BIGINT AS o FROM hit UNION ALL
 SELECT a.qid, c.id, c.entity_id, 0.0, 'dependency', a.rank, hop, dord * 100000 + c.ord - 100000 * (dord + hop) FROM hit a JOIN doc d ON d.entity_id = a.entity_id CROSS JOIN range(1, {depth + 1}) g(hop) JOIN chunk c ON c.entity_id = 'doc::'||(d.dord + hop)),
 f AS (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY hit, pos, o) AS n FROM x)
 SELECT qid, id, entity_id, round(score, 9) AS score, source, row_number() OVER (PARTITION BY qid ORDER BY hit, pos, o, id) AS rank FROM f WHERE n = 1"""


@query(_expand_sql(1))
def expand_deps(spark, d):
    return retrieval.expand(reranked(spark, d), chunks(spark, d), _calls(spark, d)).withColumn("score", F.round("score", 9))


@query(_expand_sql(2))
def expand_deps_d2(spark, d):
    return retrieval.expand(reranked(spark, d), chunks(spark, d), _calls(spark, d), 2).withColumn("score", F.round("score", 9))


@query(f"""{_CHUNKS}{_SPARSE}{_KNN}{_FUSE}, truth AS (SELECT b.item_id AS qid, c.id FROM benchmark b JOIN chunk c ON contains(c.content, b.text)),
 best AS (SELECT qid, min(rank) AS best FROM hybrid JOIN truth USING (qid, id) GROUP BY 1)
 SELECT count(*) AS n_queries, round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0 END), 4) AS p_at_1, round(avg(CASE WHEN best <= 5 THEN 1.0 ELSE 0 END), 4) AS p_at_5, round(avg(CASE WHEN best <= 10 THEN 1.0 ELSE 0 END), 4) AS r_at_10, round(avg(coalesce(1.0 / best, 0)), 4) AS mrr FROM benchmark LEFT JOIN best ON qid = item_id""")
def retrieval_eval(spark, d):
    hits = hybrid(spark, d)
    text = questions(spark, d).withColumnRenamed("text", "passage")
    truth = hits.join(chunks(spark, d).select("id", "content"), "id").join(text, "qid").filter(F.contains("content", "passage")).select("qid", "id")
    return retrieval.evaluate(questions(spark, d), hits, truth)


# --- context ----------------------------------------------------------------------------------------

_BUDGET = 700


@query(f"""WITH RECURSIVE n AS (SELECT conv_id, turn, length(coalesce(text, '')) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations),
 f AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, total, 0::BIGINT AS used, '' AS kept, false AS skipped FROM n
 UNION ALL SELECT n.conv_id, n.k, n.total, CASE WHEN used + tokens <= {_BUDGET} THEN used + tokens ELSE used END, CASE WHEN used + tokens <= {_BUDGET} THEN kept || ',' || turn ELSE kept END, skipped OR used + tokens > {_BUDGET} FROM f JOIN n ON n.conv_id = f.conv_id AND n.k = f.k + 1)
 SELECT conv_id, used, substr(kept, 2) AS kept, skipped FROM f WHERE k = total""")
def section_budget_fold(spark, d):
    """The turns of a conversation as sections, a letter a token, kept while they fit."""
    part = F.struct("turn", F.struct(F.col("turn").cast("string").alias("name"), F.lit("").alias("text"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("tokens")).alias("p"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("turns"))
    rows = rows.withColumn("f", context.fold(F.transform("turns", lambda x: x["p"]), F.lit(_BUDGET), full=True))
    return rows.select("conv_id", "f.used", F.array_join("f.kept", ",").alias("kept"), "f.skipped")


def _sufficiency_sql() -> str:
    whole = " ".join(f"WHEN '{t}' THEN {sum(1 / (i + 1) for i in range(len(o)))!r}::DOUBLE" for t, o in context.PRIORITIES.items())
    got = " ".join(f"WHEN '{t}' THEN {' + '.join(f'CASE WHEN {s} THEN {1 / (i + 1)!r}::DOUBLE ELSE 0 END' for i, s in enumerate(o))}" for t, o in context.PRIORITIES.items())
    return f"""WITH f AS (SELECT doc_id, n_chars > 2000 AS source_code, quality IS NOT NULL AS docstring, lang = 'en' AS signature, source <> 'src0' AS callers, n_chars % 2 = 0 AS callees, false AS parent, false AS children, n_chars FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)),
 g AS (SELECT *, CASE WHEN source_code THEN 0.2::DOUBLE ELSE 0 END AS bonus, unnest({list(context.PRIORITIES)}) AS task FROM f)
 SELECT doc_id, task, least(1.0, round((CASE task {got} END + bonus) * CASE WHEN n_chars < 100 THEN 0.5 ELSE 1.0 END / (CASE task {whole} END + bonus), 2)) AS sufficiency FROM g"""


def _sufficiency(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, d, "documents").join(labels, "doc_id", "left")
    flags = [("source_code", F.col("n_chars") > 2000), ("docstring", F.col("quality").isNotNull()), ("signature", F.col("lang") == "en"), ("callers", F.col("source") != "src0"), ("callees", F.col("n_chars") % 2 == 0)]
    included = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags]))
    rows = docs.select("doc_id", "n_chars", included.alias("included"), F.explode(F.array(*map(F.lit, context.PRIORITIES))).alias("task"))
    score = context.sufficiency(F.col("task"), F.col("included"), F.array_contains("included", "source_code"), F.lit(""), F.col("n_chars"))
    return rows.select("doc_id", "task", score.alias("sufficiency"))


@query(_sufficiency_sql())
def sufficiency_by_task(spark, d):
    return _sufficiency(spark, d)


@query(f"WITH s AS ({_sufficiency_sql()}) SELECT task, count(*) FILTER (sufficiency >= 0.8) AS n_local, count(*) FILTER (sufficiency < 0.8) AS n_model, round(avg(sufficiency), 4) AS mean FROM s GROUP BY task")
def local_or_llm_gate(spark, d):
    s = _sufficiency(spark, d).withColumn("to", context.gate(F.col("sufficiency"), F.lit("text")))
    return s.groupBy("task").agg(F.count(F.when(F.col("to") == "local", 1)).alias("n_local"), F.count(F.when(F.col("to") == "model", 1)).alias("n_model"), F.round(F.avg("sufficiency"), 4).alias("mean"))
