"""Helpers that the training-data operators share.

Temporary tables go to the folder that the session names in ``spark.checkpoint.dir``
(all executors share it), never to a machine's own folder.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_OWN: dict[str, str] = {}  # the folder of an application that names none


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is set and all is one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        # remembered here, as the setting is one of Spark's core that a session cannot change
        app = spark.sparkContext.applicationId
        found = _OWN[app] = _OWN.get(app) or "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage, upon which the shuffle files of finished steps are deleted."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


ROW_GROUP = 16 << 20  # bytes that a writer holds before it writes them: every core of a heap has a writer


def saved(df: DataFrame, name: str, width: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that survives lost executors.

    ``width`` bounds the number of files where the number of rows is known to be small.
    Else the step counts as large, and the shuffle files behind it are released.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df.coalesce(width) if width else df).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    if width is None:
        release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path  # for discard()
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a ``saved`` table that nothing reads any more."""
    path = getattr(df, "_graphloom_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def rows_without_columns(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Only the named columns, so that extra columns cannot clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def arrow_map(df: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` of a function from batch to table; empty batches make no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(pa.Table.from_batches([batch])).to_batches()

    return df.mapInArrow(run, schema)


BATCH_BYTES, BATCH_ROWS = 2 << 20, 20_000
READ_ROWS = 512  # of a Parquet file that are decoded at a time, however long their texts


def small_batches(df: DataFrame) -> None:
    """Bound Arrow batches by bytes, as texts may be long, and by rows; a text larger than the bound is a batch by itself.

    The readers of Parquet files know no bound by bytes, so they get one of fewer rows.
    These are settings of the session, read when a plan runs, so all operators set the
    same values.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


# --- connected components -------------------------------------------------------------------


EDGES_A_TASK = 250_000


def _settled(edges: DataFrame) -> bool:
    """Whether edges (a, b) are stars: each a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("root")).union(edges.select(F.col("b").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    return ends.groupBy("n").agg(F.sum("child").alias("c"), F.max("root").alias("r")).filter("c > 1 or (c = 1 and r = 1)").isEmpty()


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges(a long, b long)`` by alternating large-star and small-star.

    Returns ``(node long, root long)`` for every node of an edge; ``root`` is the smallest
    node of the component. Self-loops and repeated edges are harmless. Every round joins
    minima, which are pre-aggregated, back to the edges: a hub's edges are an ordinary
    skewed join that the engine splits, never one task's group. The rounds end when all
    components are stars around their smallest node. Tables of edges are written in as
    many files as their number calls for.
    """
    now = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not _settled(now):
        width = 1 + now.count() // EDGES_A_TASK
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["k"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = saved(large, name, width)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.withColumnRenamed("a", "k"), F.col("a") == F.col("k")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step = saved(small.union(low.select("a", F.col("m").alias("b"))).distinct(), name, width)
        discard(large)
        discard(now)
        now = step
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


# --- rows of a group together, without a call for each group ------------------------------------


def group_runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by integer ``keys``, with the start of every group and the end.

    A group that goes on in the next batch is held back until it is whole, so memory is
    bounded by the largest group.
    """
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in keys:
            c = table[k].to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return np.append(np.where(new)[0], table.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(batch.column(k)[batch.num_rows - 1].as_py() == held[0].column(k)[0].as_py() for k in keys):
            held.append(batch)  # all of one group
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        at = cut(table)
        if len(at) > 2:
            yield table.slice(0, at[-2]), at[:-1]
        held = table.slice(at[-2]).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, cut(table)


def shared_keys(keyed: DataFrame, value: str | None = None, first_value: str | None = None) -> DataFrame:
    """Of (key, node), or (key, node, value), all long: the rows of keys that more than one row has, with the key's first node ``a`` and its value.

    One pass over rows sorted by key; of a key that goes on from batch to batch only its
    first node is remembered, so a very common key costs no memory. Rows that repeat key
    and node are one.
    """
    names = ["key", "node", value, "a", first_value] if value else ["key", "node", "a"]
    wide = [F.col("key"), F.col("node"), *([F.col(value)] if value else [])]
    small_batches(keyed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held = (none, none, none)  # the last row, while it is the only one of its key
        begun = None  # (key, node, val) of the first row of a key that goes on
        last = None  # (key, node) of the row before the batch
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = [c.to_numpy() for c in batch.columns]
            if not value:
                raw.append(np.zeros(len(raw[0]), np.int8))
            new = np.r_[last != (raw[0][0], raw[1][0]), (raw[0][1:] != raw[0][:-1]) | (raw[1][1:] != raw[1][:-1])]
            last = (raw[0][-1], raw[1][-1])
            if not new.any():
                continue
            key, node, val = (np.concatenate([h, c[new]]) for h, c in zip(held, raw, strict=True))
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[start, len(key)])
            first, first_val, many = node[start], val[start], size > 1
            if begun is not None and begun[0] == key[0]:
                first[0], first_val[0], many[0] = begun[1], begun[2], True
            if many[-1]:
                begun, held = (key[-1], first[-1], first_val[-1]), (none, none, none)
            else:
                begun, held = None, (key[-1:], node[-1:], val[-1:])
            rows = np.repeat(many, size)
            columns = [key[rows], node[rows], val[rows], np.repeat(first, size)[rows], np.repeat(first_val, size)[rows]]
            columns = columns if value else [columns[k] for k in (0, 1, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return keyed.select(*wide).repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, ", ".join(f"{n} long" for n in names))


# --- blocked comparison inside groups ---------------------------------------------------------


def tiles(df: DataFrame, group: str, id_col: str, block: int) -> DataFrame:
    """Split every group into blocks of about ``block`` rows and pair the blocks up.

    ``df`` gets the columns ``ta``, ``tb`` (the two blocks of a tile, ``ta <= tb``) and
    ``mine`` (the row's block). Grouping by ``(group, ta, tb)`` brings together any two
    rows of a group exactly once or, in the tiles with ``ta = tb``, within one block. A
    tile holds about ``2 * block`` rows whatever the size of the group.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n_")).filter("n_ > 1").select(F.col(group).alias("g_"), F.ceil(F.col("n_") / block).cast("int").alias("t_"))
    at = df.join(sizes, F.col(group) == F.col("g_")).drop("g_").withColumn("mine", F.pmod(F.xxhash64(id_col), F.col("t_")).cast("int"))
    at = at.withColumn("o_", F.explode(F.sequence(F.lit(0), F.col("t_") - 1)))
    return at.withColumn("ta", F.least("mine", "o_")).withColumn("tb", F.greatest("mine", "o_")).drop("o_", "t_")
