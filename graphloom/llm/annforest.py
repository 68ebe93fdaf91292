"""Approximate nearest neighbours with a forest of random-projection trees.

Trees are fitted on a bounded sample; every vector is then put into one leaf of each
tree. A query walks all trees through one shared priority queue (the node with the least
distance beyond its split planes comes next, whichever tree it is in) until the leaves
taken hold enough vectors. Equal vectors are one entry throughout; those found are
expanded to their smallest ids at the end. Candidates are scored exactly, in double precision, leaf by
leaf in blocks, and the best of all leaves are kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small_batches

TREES = 12
SAMPLE = 20_000  # vectors that the trees are fitted on, at most
LEAF = 128  # sampled vectors in a leaf, at most
SHARE = 0.06  # part of all (distinct vector, tree) entries that a query looks at ...
LEAST = 4_000  # ... and the least number of them, which is more than the share where there are fewer than 5,555 vectors
BLOCK = 2048
TOP = 5
EVERY = 50


def unit(flat: np.ndarray) -> np.ndarray:
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


class Tree:
    """Split planes (normal, offset) and children; a leaf has child -1 and a number."""

    def __init__(self, x: np.ndarray, rng: np.random.Generator, leaf: int):
        self.normal, self.offset, self.kids, self.leaf = [], [], [], []
        self.leaves = 0
        todo = [(np.arange(len(x)), self._add(x.shape[1]))]
        while todo:
            rows, node = todo.pop()
            side = None
            if len(rows) > leaf:
                for _ in range(4):
                    a, b = x[rng.choice(rows, 2, replace=False)]
                    w = a - b
                    if not w.any():
                        continue
                    w = w / np.linalg.norm(w)
                    at = x[rows] @ w
                    cut = float(np.median(at))
                    split = at > cut
                    if 0 < split.sum() < len(rows):
                        side = split
                        break
            if side is None:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            self.normal[node], self.offset[node] = w, cut
            self.kids[node] = (self._add(x.shape[1]), self._add(x.shape[1]))
            todo += [(rows[~side], self.kids[node][0]), (rows[side], self.kids[node][1])]
        self.normal = np.array(self.normal)
        self.offset = np.array(self.offset)
        self.kids, self.leaf = np.array(self.kids), np.array(self.leaf)

    def _add(self, width: int) -> int:
        self.normal.append(np.zeros(width))
        self.offset.append(0.0)
        self.kids.append((-1, -1))
        self.leaf.append(-1)
        return len(self.leaf) - 1

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, all rows going down together."""
        at = np.zeros(len(x), np.int64)
        while (inner := np.where(self.leaf[at] < 0)[0]).size:
            node = at[inner]
            right = np.einsum("ij,ij->i", x[inner], self.normal[node]) > self.offset[node]
            at[inner] = np.where(right, self.kids[node, 1], self.kids[node, 0])
        return self.leaf[at]


class Forest:
    def __init__(self, x: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees = [Tree(x, rng, leaf) for _ in range(trees)] if len(x) else []

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Rows by trees: the leaf numbers."""
        return np.stack([t.leaf_of(x) for t in self.trees], 1)

    def visit(self, q: np.ndarray, sizes: list[np.ndarray], wanted: int) -> list[tuple[int, int]]:
        """(tree, leaf) pairs in the order of the shared queue until ``wanted`` entries are reached."""
        dots = [t.normal @ q - t.offset for t in self.trees]
        heap = [(0.0, k, 0) for k in range(len(self.trees))]
        out, n = [], 0
        while heap and n < wanted:
            far, k, node = heapq.heappop(heap)
            t, d = self.trees[k], dots[k]
            while t.leaf[node] < 0:
                right = d[node] > 0
                heapq.heappush(heap, (max(far, abs(d[node])), k, int(t.kids[node, 0 if right else 1])))
                node = int(t.kids[node, 1 if right else 0])
            leaf = int(t.leaf[node])
            if sizes[k][leaf]:
                out.append((k, leaf))
                n += int(sizes[k][leaf])
        return out


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of vectors that can be compared, in their own type: not null, not zero, all components finite.

    Vectors of different lengths have no cosine: those of the commonest length (of equally
    common ones the largest) are the table's, all others cannot be compared.
    """
    v = F.col("v")
    out = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).filter("id is not null and v is not null and size(v) > 0")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    out = out.filter(fine & F.exists(v, lambda c: c != 0.0))
    length = out.groupBy(F.size("v").alias("l")).count().orderBy(F.desc("count"), F.desc("l")).first()
    return out.filter(F.size("v") == F.lit(length["l"] if length else 0))


def matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sample(rows: DataFrame, n: int = SAMPLE) -> np.ndarray:
    """At most ``n`` vectors in hash order, as unit rows."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(n).select("v").toArrow()
    return unit(matrix(some["v"])) if some.num_rows else np.zeros((0, 1))


def search(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", every: int = EVERY, top: int = TOP) -> DataFrame:
    """The ``top`` nearest by cosine of each query (ids divisible by ``every``): query_id, rank, vec_id, score.

    Every other row is a candidate; ties fall to the smaller id. Vectors null, zero or with
    null or non-finite components take no part, nor do rows without an id. Rows that
    repeat an id with the same vector are one vector; with other vectors, the best of
    them counts. Vectors of another length than the commonest take no part. An empty
    table gives no rows.
    """
    small_batches(vectors)
    spark = vectors.sparkSession
    ids = usable(vectors, id_col, vector).select("id", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(7), F.col("v")).alias("k2"), "v")
    rows = ids.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.first("v").alias("v"))
    rows = saved(rows.select(F.monotonically_increasing_id().alias("id"), "first", "k1", "k2", "v"), "vectors")
    once = saved(ids.select("id", "k1", "k2").distinct(), "ids")
    # ids with several vectors: so many more vectors are kept that enough ids are among them
    keep = (top + 1) * ((once.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]) or 1)
    salted, whole = (Window.partitionBy("k1", "k2", *salt).orderBy("id") for salt in ([F.pmod(F.xxhash64("id"), F.lit(64))], []))
    members = once.withColumn("n_", F.row_number().over(salted)).filter(F.col("n_") <= keep).withColumn("n_", F.row_number().over(whole)).filter(F.col("n_") <= keep)
    members = saved(members.join(rows.select("k1", "k2", F.col("id").alias("vid")), ["k1", "k2"]).select("vid", F.col("id").alias("vec_id")), "members")
    asking = saved(once.filter(F.col("id") % every == 0).join(rows.select("k1", "k2", F.col("id").alias("qid")), ["k1", "k2"]).select("qid", F.col("id").alias("query_id")), "asking")
    rows = rows.select("id", "first", "v")
    kind = rows.schema["v"].dataType.simpleString()
    forest = Forest(sample(rows.select(F.col("first").alias("id"), "v")))
    if not forest.trees:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(forest)  # bounded by SAMPLE

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row once for each tree, in its leaf, with all its columns."""
        trees = shared.value
        for batch in batches:
            if batch.num_rows:
                leaves = trees.leaves(unit(matrix(batch.column(batch.num_columns - 1))))
                n, k = leaves.shape
                at = pa.array(np.repeat(np.arange(n), k))
                columns = [pa.array(np.tile(np.arange(k, dtype=np.int32), n)), pa.array(leaves.ravel().astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, *(c.take(at) for c in batch.columns)], ["tree", "leaf", *batch.schema.names])

    sizes = rows.select("v").mapInArrow(place, f"tree int, leaf int, v {kind}").groupBy("tree", "leaf").agg(F.count("*").alias("n")).toPandas()  # a row per leaf
    count = [np.zeros(t.leaves, np.int64) for t in forest.trees]
    for tree, leaf, n in sizes.itertuples(index=False):
        count[tree][leaf] = n
    wanted = int(max(LEAST, SHARE * sizes["n"].sum()))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            q, t, f = [], [], []
            for row, v in enumerate(unit(matrix(batch.column(1))) if batch.num_rows else []):
                for tree, leaf in trees.visit(v, count, wanted):
                    q.append(row)
                    t.append(tree)
                    f.append(leaf)
            at = pa.array(q, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(f, pa.int32()), batch.column(0).take(at), batch.column(1).take(at)], ["tree", "leaf", "query_id", "qv"])

    queries = rows.join(asking.select(F.col("qid").alias("id")).distinct(), "id", "left_semi").select("id", "v")
    walks = queries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("id")).mapInArrow(walk, f"tree int, leaf int, query_id long, qv {kind}")
    parts = sizes_of(spark, count)
    split = (F.col("tree") == F.col("t_")) & (F.col("leaf") == F.col("f_"))
    base = rows.mapInArrow(place, f"tree int, leaf int, id long, first long, v {kind}").join(F.broadcast(parts), split).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    asked = walks.join(F.broadcast(parts), split).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, firsts, base_v = right["id"].to_numpy(), right["first"].to_numpy(), unit(matrix(right["v"]))
            for lo in range(0, left.num_rows, BLOCK):
                some = left.slice(lo, BLOCK)
                score = unit(matrix(some["qv"])) @ base_v.T
                for q, row in zip(some["query_id"].to_numpy(), score, strict=True):
                    row = np.where(ids == q, -np.inf, row)
                    least = np.partition(row, -keep)[-keep] if len(row) > keep else -np.inf
                    near = np.where((row >= least) & (row > -np.inf))[0]
                    near = near[np.lexsort((firsts[near], -row[near]))][:keep]
                    out.append((np.full(len(near), q), ids[near], row[near]))
        columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table(columns, names=["qid", "vid", "score"])

    keys = ["tree", "leaf", "part"]
    near = asked.select(*keys, "query_id", "qv").groupBy(*keys).cogroup(base.select(*keys, "id", "first", "v").groupBy(*keys)).applyInArrow(rank, "qid long, vid long, score double")
    near = near.groupBy("qid", "vid").agg(F.max("score").alias("score")).union(asking.select("qid", F.col("qid").alias("vid"), F.lit(1.0)).distinct())
    # per distinct query vector: its nearest ids; then per query, less itself
    found = near.join(members, "vid").groupBy("qid", "vec_id").agg(F.max("score").alias("score"))
    found = found.withColumn("n_", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n_") <= keep).drop("n_")
    return best(found.join(asking, "qid").filter("vec_id <> query_id").select("query_id", "vec_id", "score"), top).select("query_id", "rank", "vec_id", "score")


def sizes_of(spark, count: list[np.ndarray]) -> DataFrame:
    """(t_, f_, parts): into how many blocks each leaf is split; one row per leaf, so its size is bounded."""
    rows = [(k, f, int(max(1, -(-n // BLOCK)))) for k, c in enumerate(count) for f, n in enumerate(c.tolist())]
    return spark.createDataFrame(rows, "t_ int, f_ int, parts int")


def best(near: DataFrame, top: int) -> DataFrame:
    """The first ``top`` candidates of each query; the score of a pair is the largest found."""
    once = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
