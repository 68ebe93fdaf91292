"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Cells are fitted on a bounded sample. Every vector has a home cell (its nearest centre)
and is copied as a guest into each cell that could hold a partner: for a home centre c
and another centre d, a vector y can only have a partner within angle t on d's side of
the plane between both where y.(c - d) <= sin(t) * |c - d|. So no link is lost. In a
cell, blocks of home vectors are multiplied with blocks of all its vectors; a vector's
links are counted in its home cell alone, and every product of blocks gives a spanning
forest of its links, not the links themselves.

Equal vectors are one vector with a weight from the start, so a large group of copies
costs nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .annforest import matrix, sample, unit, usable
from .common import components, saved, small_batches

COSINE = 0.95
CELL = 8192  # vectors for each cell, about
MOST_CELLS = 1024
SAMPLE = 20_000  # vectors that the centres are fitted on, at most
ROUNDS = 8
HOME, GUESTS = 4096, 16384  # rows of a block on either side
CHUNK = 512


def centres(x: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """Spherical k-means on unit rows: mean direction of each cell, starting from distinct rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(ROUNDS):
        home = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def cells(x: np.ndarray, c: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit row, and a rows-by-cells table of where it belongs (home included)."""
    dots = x @ c.T
    home = dots.argmax(1)
    gap = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))
    reach = np.sqrt(max(1 - cosine * cosine, 0.0)) if cosine > 0 else 2.0
    return home, dots.max(1)[:, None] - dots <= reach * gap[home] + 1e-9


def forest(linked: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Star edges (node, smallest id) of each component of a block of links between row and column ids."""
    out = []
    free_r, free_c = linked.any(1), linked.any(0)
    for seed in np.where(free_r)[0]:
        if not free_r[seed]:
            continue
        new_r = np.zeros(len(rows), bool)
        new_r[seed] = True
        got_r, got_c = new_r.copy(), np.zeros(len(cols), bool)
        free_r[seed] = False
        while new_r.any():
            new_c = linked[new_r].any(0) & free_c
            free_c &= ~new_c
            got_c |= new_c
            new_r = linked[:, new_c].any(1) & free_r
            free_r &= ~new_r
            got_r |= new_r
        nodes = np.unique(np.concatenate([rows[got_r], cols[got_c]]))
        if len(nodes) > 1:
            out.append((nodes[1:], np.full(len(nodes) - 1, nodes[0])))
    return out


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Needs ``vec_id`` and ``embedding``; other columns are left out. Vectors that are null,
    zero, hold null or non-finite components or are of another length than the commonest
    (of equally common ones the largest) link with nothing. A null vec_id is never
    linked: its component_id is null and it is kept. Rows that repeat an id with an equal
    vector are one vector. An empty table gives no rows.
    """
    small_batches(vectors)
    spark = vectors.sparkSession
    keys = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(7), F.col("v")).alias("k2")]
    ids = usable(vectors).select("id", *keys, "v")
    once = saved(ids.select("id", "k1", "k2").distinct(), "ids")
    reps = ids.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("v").alias("v"))
    counts = once.groupBy("k1", "k2").agg(F.count("*").alias("weight"))
    reps = saved(reps.join(counts, ["k1", "k2"]).select("k1", "k2", "rep", "weight", "v"), "vectors")
    n = reps.count()
    some = sample(reps.select(F.col("rep").alias("id"), "v"), SAMPLE)
    k = int(min(MOST_CELLS, max(1, round(n / CELL)), max(1, len(some))))
    c = centres(some, k) if len(some) else some
    kind = reps.schema["v"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                home, at = cells(unit(matrix(batch.column(2))), c, cosine)
                row, cell = np.where(at)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(home[row] == cell), *(x.take(take) for x in batch.columns)], ["cell", "home", "rep", "weight", "v"])

    placed = reps.select("rep", "weight", "v").mapInArrow(place, f"cell int, home boolean, rep long, weight long, v {kind}")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("h")).filter("h > 0")
    sizes = spark.createDataFrame([(r["cell"], -(-r["h"] // HOME), -(-r["n"] // GUESTS)) for r in sizes.collect()], "c_ int, homes int, parts int")  # a row per cell
    placed = placed.join(F.broadcast(sizes), F.col("cell") == F.col("c_"))
    mine = placed.filter("home").withColumn("h", F.pmod(F.xxhash64("rep"), F.col("homes")).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    all_of = placed.withColumn("p", F.pmod(F.xxhash64(F.lit(3), F.col("rep")), F.col("parts")).cast("int")).withColumn("h", F.explode(F.sequence(F.lit(0), F.col("homes") - 1)))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if left.num_rows and right.num_rows:
            a, b = left["m_rep"].to_numpy(), right["rep"].to_numpy()
            x, y, weight = unit(matrix(left["m_v"])), unit(matrix(right["v"])), right["weight"].to_numpy()
            y32 = y.astype(np.float32)
            links, number = [], np.zeros(len(a), np.int64)
            for lo in range(0, len(a), CHUNK):
                rough = x[lo : lo + CHUNK].astype(np.float32) @ y32.T >= cosine - 1e-4
                r, s = np.where(rough.any(1))[0], np.where(rough.any(0))[0]
                if len(r):
                    exact = x[lo + r] @ y[s].T >= cosine
                    number[lo + r] = exact @ weight[s]
                    links.append((lo + r, s, exact))
            out += [(a[number > 0], np.full((number > 0).sum(), -1), number[number > 0])]
            for r, s, exact in links:
                out += [(node, root, np.zeros(len(node), np.int64)) for node, root in forest(exact, a[r], b[s])]
        return pa.table([np.concatenate([o[i] for o in out]) for i in range(3)], names=["a", "b", "n"])

    tile = ["cell", "h", "p"]
    slim = [*tile, "rep", "weight", "v"]
    mine = mine.select(*[F.col(x).alias(f"m_{x}") for x in slim])
    found = mine.groupBy(*[f"m_{x}" for x in tile]).cogroup(all_of.select(*slim).groupBy(*tile)).applyInArrow(compare, "a long, b long, n long")
    found = saved(found, "links")
    number = found.filter("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    member = saved(once.join(reps.select("k1", "k2", "rep", "weight"), ["k1", "k2"]).join(number, "rep", "left").select("id", "k1", "k2", "rep", F.coalesce(F.col("n"), F.col("weight")).alias("n")), "members")
    edges = found.filter("n = 0").select("a", "b").union(member.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    roots = components(edges)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).select("vec_id", *keys)
    out = rows.join(member.select(F.col("id").alias("vec_id"), "k1", "k2", "n"), ["vec_id", "k1", "k2"], "left").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    root = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.greatest(F.coalesce(F.col("n") - 1, F.lit(0)), F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(root == F.col("vec_id"), F.lit(True)).alias("kept"))
