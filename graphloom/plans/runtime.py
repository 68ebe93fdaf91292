"""The session's shared folder, and cuts in the lineage of iterative plans."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``; a temporary one only where none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer bytes than one input split for each core, dealt to all cores.

    Such a table may be one row group, so one task, whatever the number of cores. The
    exchange is bounded by that size; a larger table has splits enough and stays as it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df


PART_BYTES = 2 << 20  # of a table's stored columns that a task gets by ``dealt``
MOST_PARTS = 10_000


def parts(df: DataFrame) -> int:
    """How many tasks ``dealt`` needs for a table: by the size of its files, and no fewer than there are cores."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES)), MOST_PARTS)


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows dealt by keys to ``n`` tasks, which the engine does not merge: what a task sorts or groups is as much whatever the size of the table."""
    return df.repartition(n, *keys)


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back, so that lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
