"""Chunking, sparse and dense search, fusion, reranking and evaluation, for batches of queries.

Queries are tables with ``qid``; every ranking is per query, so any number of queries is
one job. Ranks start at 1 and ties are settled by ``ord``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

SIZE, OVERLAP = 1000, 100
RRF_K, ALPHA = 60, 0.5
BOOST_DOCSTRING, BOOST_RECENT, BOOST_EXACT, BOOST_KIND = 1.2, 1.1, 1.5, 2.0
RECENT_DAYS = 7
ASKED_ROWS = 200_000  # (query, token) rows or query vectors that are sent to the data in one piece; beyond, they are joined
AT_ONCE = 1 << 20  # hits of tokens that a task counts together


def chunk(e: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Overlapping windows of ``content``: id, entity_id, chunk_index, content and the other columns.

    A text that fits is one chunk; windows stop when the end is reached.
    """
    n = X.window_count(F.length("content"), size, overlap)
    at = e.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), n - 1)))
    out = at.withColumn("content", F.expr(f"substring(content, chunk_index * {size - overlap} + 1, {size})"))
    return out.withColumn("id", F.concat("entity_id", F.lit("::"), F.col("chunk_index").cast("string")))


def postings(chunks: DataFrame) -> DataFrame:
    """Inverted index (token, id, ord): each distinct token of each chunk."""
    return chunks.select("id", "ord", F.explode(F.array_distinct(X.tokenize(F.col("content")))).alias("token"))


def _top(scored: DataFrame, limit: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit)


def _collected(asked: DataFrame) -> pa.Table | None:
    """Queries as a table, if they are few enough to be sent to the data."""
    few = asked.limit(ASKED_ROWS + 1).toArrow()
    return few if few.num_rows <= ASKED_ROWS else None


def _best(best: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Of each row of both, the highest values, as many as ``best`` has, in any order."""
    return np.partition(np.concatenate([best, score], axis=1), score.shape[1], axis=1)[:, score.shape[1] :]


def overlaps(batches: Iterator[pa.RecordBatch], asked: pa.Table, qids: pa.Array, limit: int) -> Iterator[pa.RecordBatch]:
    """qid, id, overlap, ord: of (id, ord, distinct tokens) what can be among the ``limit`` best of a query.

    Rows are taken as many at a time as have about AT_ONCE hits, and what the best so far
    beat is left out, so memory does not grow with the batches nor with the table.
    """
    n = len(qids)
    if not n:
        return
    number = pc.index_in(asked["qid"], value_set=qids).to_numpy()
    words = asked["token"].unique()
    word = pc.index_in(asked["token"], value_set=words).to_numpy()
    of = number[np.argsort(word, kind="stable")].astype(np.int64)  # the queries of each word
    size = np.bincount(word, minlength=len(words))
    first = np.cumsum(size) - size
    best = np.zeros((n, limit), np.int32)
    for batch in batches:
        lists = batch.column(2)
        flat = lists.flatten()
        found = pc.index_in(flat, value_set=words.cast(flat.type)).fill_null(-1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        row, found = row[found >= 0], found[found >= 0]
        done = np.cumsum(size[found])
        ords = batch.column(1)
        place = ords.to_numpy() if pa.types.is_integer(ords.type) and not ords.null_count else np.zeros(batch.num_rows, np.int8)
        lo = 0
        while lo < len(row):
            before = done[lo] - size[found[lo]]
            hi = int(np.searchsorted(row, row[max(lo, int(np.searchsorted(done, before + AT_ONCE, "right")) - 1)], "left"))
            hi = hi if hi > lo else int(np.searchsorted(row, row[lo], "right"))  # whole rows, one at least
            if done[-1] <= before + AT_ONCE:
                hi = len(row)
            k, at, base = found[lo:hi], row[lo:hi], row[lo]
            hits = np.repeat(first[k] - np.cumsum(size[k]) + size[k], size[k]) + np.arange(size[k].sum())
            cell = np.repeat(at - base, size[k]) * n + of[hits]
            cells = int(at[-1] - base + 1) * n
            if cells <= 4 * AT_ONCE:
                count = np.bincount(cell, minlength=cells)
                cell = np.flatnonzero(count)
                count = count[cell]
            else:
                cell, count = np.unique(cell, return_counts=True)
            lo = hi
            q, at = cell % n, cell // n + base
            some = count >= best.min(axis=1)[q]
            q, at, count = q[some], at[some], count[some]
            order = np.lexsort((place[at], -count, q))
            q, at, count = q[order], at[order], count[order]
            start = np.searchsorted(q, q)
            last = np.minimum(start + limit - 1, max(len(q) - 1, 0))
            # with all that equal the last one kept, so that those ties are settled later
            keep = (np.arange(len(q)) < start + limit) | (q[last] == q) & (count[last] == count) & (place[at[last]] == place[at])
            q, at, count, rank = q[keep], at[keep], count[keep], (np.arange(len(start)) - start)[keep]
            mine, inverse = np.unique(q, return_inverse=True)
            new = np.zeros((len(mine), limit), np.int32)
            new[inverse[rank < limit], rank[rank < limit]] = count[rank < limit]
            best[mine] = _best(best[mine], new)
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), batch.column(0).take(pa.array(at)), pa.array(count, pa.int64()), ords.take(pa.array(at))], ["qid", "id", "overlap", "ord"])


def overlap_search(chunks: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """qid, id, overlap, rank: chunks that share most distinct tokens with the query's text.

    ``chunks`` has id, ord and content, or tokens already made. The queries' tokens are
    sent to the chunks, so nothing but each batch's best per query is shuffled; with more
    than ASKED_ROWS of them an inverted index is joined instead.
    """
    asked = queries.select("qid", F.explode(F.array_distinct(X.tokenize(F.col("text")))).alias("token"))
    few = _collected(asked)
    if few is None:
        found = postings(chunks).join(asked, "token").groupBy("qid", "id").agg(F.count("*").alias("overlap"), F.min("ord").alias("ord"))
    else:
        kind = asked.schema["qid"].dataType.simpleString()
        qids = few["qid"].unique()
        qids = qids.combine_chunks() if isinstance(qids, pa.ChunkedArray) else qids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return overlaps(batches, few, qids, limit)

        tokens = F.array_distinct(F.col("tokens") if "tokens" in chunks.columns else X.tokenize(F.col("content")))
        rows = chunks.select("id", "ord", tokens.alias("tokens"))
        found = rows.mapInArrow(run, f"qid {kind}, id string, overlap long, ord {rows.schema['ord'].dataType.simpleString()}")
    return _top(found, limit, F.desc("overlap"), F.col("ord"), F.col("id")).select("qid", "id", "overlap", "rank")


def knn(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """qid, id, score, rank: exact search by inner product of every query with every vector.

    Queries are a stated set of at most ASKED_ROWS: they are sent to the vectors in one
    piece, which keeps the scan of the vectors free of shuffles, and each task gives what
    the best ``limit`` per query so far (by matrix products of bounded size) do not beat
    before anything is exchanged. Null vectors
    and those of another length than a query's are not found by it.
    """
    few = _collected(queries.select("qid", "embedding").filter("embedding is not null"))
    if few is None:
        raise ValueError(f"more than {ASKED_ROWS} query vectors: ask in several calls")
    kind = queries.schema["qid"].dataType.simpleString()
    by_length: dict[int, tuple[list[int], list]] = {}
    for k, v in enumerate(few["embedding"].to_pylist()):
        rows, made = by_length.setdefault(len(v), ([], []))
        rows.append(k)
        made.append(v)
    asked = {n: (np.array(rows), np.array(made, np.float64)) for n, (rows, made) in by_length.items() if n}
    qids = few["qid"].combine_chunks() if few.num_rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {length: np.full((len(q), limit), -np.inf) for length, (_, q) in asked.items()}
        for batch in batches:
            lists = batch.column(2)
            n = np.diff(lists.offsets.to_numpy())
            for length, (rows, q) in asked.items():
                whole = np.flatnonzero((n == length) & ~np.asarray(lists.is_null()))
                for k in range(0, len(whole), 1024):
                    some = whole[k : k + 1024]
                    flat = lists.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), length)
                    for lo in range(0, len(q), 1024):
                        score = q[lo : lo + 1024] @ flat.T
                        high = np.where(np.isnan(score), np.inf, score)
                        mine = best[length][lo : lo + 1024]
                        mine[:] = _best(mine, high)
                        i, j = np.where(high >= mine.min(axis=1, keepdims=True) - 1e-8)  # more than rounding can change
                        at = pa.array(some[j])
                        yield pa.RecordBatch.from_arrays([qids.take(pa.array(rows[lo + i])), batch.column(0).take(at), pa.array(score[i, j]), batch.column(1).take(at)], ["qid", "id", "score", "ord"])

    rows = vectors.select("id", "ord", "embedding")
    found = rows.mapInArrow(run, f"qid {kind}, id string, score double, ord {rows.schema['ord'].dataType.simpleString()}")
    scored = found.withColumn("score", F.round("score", 9))
    return _top(scored, limit, F.desc("score"), F.col("ord")).select("qid", "id", "score", "rank")


def fuse(sparse: DataFrame, dense: DataFrame, limit: int, alpha: float = ALPHA, k: int = RRF_K) -> DataFrame:
    """qid, id, score, rank: reciprocal rank fusion; ties go by sparse, then dense rank."""
    s = sparse.select("qid", "id", ((1 - alpha) / (k + F.col("rank"))).alias("sp"), F.col("rank").alias("sr"))
    d = dense.select("qid", "id", (alpha / (k + F.col("rank"))).alias("dp"), F.col("rank").alias("dr"))
    both = s.join(d, ["qid", "id"], "full").withColumn("score", F.coalesce("sp", F.lit(0.0)) + F.coalesce("dp", F.lit(0.0)))
    return _top(both, limit, F.desc(F.round("score", 12)), F.asc_nulls_last("sr"), F.asc_nulls_last("dr")).select("qid", "id", "score", "rank")


def rerank(hits: DataFrame, queries: DataFrame, chunks: DataFrame, limit: int | None, now: str | None = None) -> DataFrame:
    """qid, id, score, rank after boosts for docstrings, recent changes, the whole query in the text, and the kind asked for."""
    wide = hits.join(queries.select("qid", F.col("text").alias("q")), "qid").join(chunks, "id")
    factor = F.when(F.lower("has_docstring") == "true", BOOST_DOCSTRING).otherwise(1.0)
    if now is not None and "last_modified" in chunks.columns:
        changed = F.try_to_timestamp(F.col("last_modified"))
        factor = factor * F.when(changed >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {RECENT_DAYS} DAYS"), BOOST_RECENT).otherwise(1.0)
    factor = factor * F.when(F.contains(F.lower("content"), F.lower("q")), BOOST_EXACT).otherwise(1.0)
    factor = factor * F.when(F.lower("q") == F.lower("kind"), BOOST_KIND).otherwise(1.0)
    scored = wide.withColumn("score", F.col("score") * factor).withColumnRenamed("rank", "before")
    return _top(scored, limit or 1 << 30, F.desc(F.round("score", 12)), F.col("before")).select("qid", "id", "score", "rank")


def expand(hits: DataFrame, chunks: DataFrame, calls: DataFrame, depth: int = 1) -> DataFrame:
    """Hits followed by the chunks of what their entities call: qid, id, entity_id, score, source, rank.

    Calls are followed ``depth`` hops from each hit, breadth first and each entity once, in
    the order of calls. The first occurrence of a chunk decides, so a later hit that an
    earlier one already brought in as a dependency stays a dependency with score 0.
    """
    places = chunks.select("id", "entity_id", F.col("ord").alias("o"))
    edges = calls.select(F.col("source_id").alias("from_id"), F.col("target_id").alias("entity_id"), F.col("ord").alias("edge"))
    at = hits.join(places, "id")
    start = F.array().cast(T.ArrayType(edges.schema["edge"].dataType))
    out = at.select("qid", "id", "entity_id", "score", F.lit("retrieved").alias("source"), F.col("rank").alias("hit"), F.lit(0).alias("pos"), start.alias("path"), "o")
    level = at.select("qid", F.col("rank").alias("hit"), "entity_id", start.alias("path"))
    seen = level.select("qid", "hit", "entity_id")
    for hop in range(1, depth + 1):
        ends = level.withColumnRenamed("entity_id", "from_id").join(edges, "from_id").join(seen, ["qid", "hit", "entity_id"], "left_anti")
        level = ends.groupBy("qid", "hit", "entity_id").agg(F.min(F.concat("path", F.array("edge"))).alias("path"))
        seen = seen.unionByName(level.select("qid", "hit", "entity_id"))
        out = out.unionByName(level.join(places, "entity_id").select("qid", "id", "entity_id", F.lit(0.0).alias("score"), F.lit("dependency").alias("source"), "hit", F.lit(hop).alias("pos"), "path", "o"))
    first = F.row_number().over(Window.partitionBy("qid", "id").orderBy("hit", "pos", "path", "o"))
    once = out.withColumn("n", first).filter("n = 1")
    order = F.row_number().over(Window.partitionBy("qid").orderBy("hit", "pos", "path", "o", "id"))
    return once.withColumn("rank", order).select("qid", "id", "entity_id", "score", "source", "rank")


def distinct_entities(hits: DataFrame, n: int) -> DataFrame:
    """The first ``n`` distinct entities of each query's retrieved chunks."""
    best = hits.filter("source = 'retrieved'").groupBy("qid", "entity_id").agg(F.min("rank").alias("at"))
    return _top(best, n, F.col("at")).select("qid", "entity_id", "rank")


def evaluate(queries: DataFrame, hits: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: hit rate at 1, 5 and 10 and mean reciprocal rank; a query without a hit counts as a miss."""
    best = hits.join(truth, ["qid", "id"]).groupBy("qid").agg(F.min("rank").alias("best"))
    per = queries.select("qid").join(best, "qid", "left")
    rate = lambda k: F.round(F.avg(F.when(F.col("best") <= k, 1.0).otherwise(0.0)), 4)
    return per.agg(F.count("*").alias("n_queries"), rate(1).alias("p_at_1"), rate(5).alias("p_at_5"), rate(10).alias("r_at_10"), F.round(F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))), 4).alias("mrr"))
