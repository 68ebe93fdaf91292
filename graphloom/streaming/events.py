"""Windowed aggregates and keyed upserts over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet", late: str = "10 minutes") -> DataFrame:
    """Files of events as a stream with event time and watermark."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", name).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    return _windows(events, F.window("ts", width), "event_type")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day") -> DataFrame:
    return _windows(events, F.window("ts", width, step), "event_type")


def sessions(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    return _windows(events, F.session_window("ts", gap), "user_id")


def _windows(events: DataFrame, window, key: str) -> DataFrame:
    counted = events.groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def drain(stream: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Run a stream over what is there and return."""
    query = stream.writeStream.foreachBatch(upsert).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


class KeyedTable:
    """A table of versions in shared storage: a batch writes the whole next version, so a batch that is run again changes nothing.

    ``replace`` removes all rows of the keys in a batch before its rows are added, the
    form a re-indexed file needs (old chunks go).
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys

    def _path(self, version: int) -> str:
        return f"{self.folder}/v{version}"

    def read(self, version: int) -> DataFrame | None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(version) + "/_SUCCESS")
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.parquet(self._path(version)) if files.exists(where) else None

    def replace(self, batch: DataFrame, batch_id: int) -> None:
        before = self.read(batch_id - 1) if batch_id > 0 else None
        if before is not None:
            batch = before.join(batch.select(*self.keys).distinct(), self.keys, "left_anti").unionByName(batch)
        batch.write.mode("overwrite").parquet(self._path(batch_id))
