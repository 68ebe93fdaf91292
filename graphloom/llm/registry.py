"""Queries of the training-data operators: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import annforest, bpe, embdup, html, linededup, neardup, packing, quality, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embdup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op6_annforest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annforest.search(_table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicate(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_embdup, op2_bpe, op3_toxicity, op4_minhash, op5_warc, op6_annforest, op7_packing, op8_html, op9_quality, op10_linededup]
    return {f.__name__: f for f in found}


#: All pairs of usable vectors; components by reachability.
OP1_SQL = """
WITH RECURSIVE listed AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL),
fine AS (
  SELECT vec_id, v FROM listed
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(v, lambda c: c <> 0)) > 0
),
known AS (SELECT DISTINCT vec_id, v FROM fine WHERE len(v) = (SELECT len(v) FROM fine GROUP BY len(v) ORDER BY count(*) DESC, len(v) DESC LIMIT 1)),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM known a JOIN known b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT a AS node, b AS seen FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
root AS (SELECT node, least(node, min(seen)) AS root FROM reach GROUP BY node),
degree AS (SELECT a AS node, count(DISTINCT b) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(r.root, e.vec_id) AS component_id, coalesce(coalesce(r.root, e.vec_id) = e.vec_id, true) AS kept
FROM embeddings e LEFT JOIN degree d ON d.node = e.vec_id LEFT JOIN root r ON r.node = e.vec_id
"""

#: All pairs of documents that share a shingle, by their whole sets; components by reachability.
OP4_SQL = r"""
WITH RECURSIVE said AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda k: array_to_string(words[k:k + 4], ' ')) END) AS gram FROM said
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
half AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * met >= 75 * (x.n + y.n - met)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT a AS node, b AS seen FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
root AS (SELECT node, least(node, min(seen)) AS root FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, coalesce(r.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN root r ON r.node = d.doc_id
"""

#: What the archives must hold, from the pages themselves.
OP5_SQL = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
seen AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS last FROM rows)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to
FROM seen
"""


def oracle_sql() -> dict[str, str]:
    """SQL twins of the operators whose results SQL can state; tests hold the others against brute force."""
    return {"op1_embdup": OP1_SQL, "op4_minhash": OP4_SQL, "op5_warc": OP5_SQL}
