"""A source tree that is indexed again as its files appear and change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import LOG, Settings
from ..extract import base
from ..operators import chunking, graph
from ..plans.runtime import materialised
from ..sources import files

PARTS = 64  # folders by hash of the path; a change rewrites those of its files only


class FileIndexer:
    """Chunks of a tree's files in shared storage, kept up to date by listings.

    A file is indexed when its path, time of change or size is new. Its chunks carry that
    time and count only if the listing that is written after them says so; where a run is
    lost half-way, its files are still new to the next one. A file that cannot be
    read or parsed has an error in the listing and no chunks, and never stops the others.
    Files that are gone keep their chunks.
    """

    def __init__(self, spark: SparkSession, root: str, folder: str, gitignore: str | None = None, more: tuple[str, ...] = (), settings: Settings | None = None):
        self.spark, self.root, self.folder = spark, root, folder.rstrip("/")
        self.rules, self.settings = (gitignore, more), settings or Settings()

    def _read(self, name: str) -> DataFrame | None:
        # a write that replaces single folders leaves no mark of success at the top
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/part=*")
        there = len(where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where) or []) > 0
        return self.spark.read.parquet(f"{self.folder}/{name}") if there else None

    def _rewrite(self, name: str, rows: DataFrame, changed: DataFrame, parts: list[int]) -> None:
        before = self._read(name)
        if before is not None:
            kept = before.filter(F.col("part").isin(parts)).join(changed.select("path"), "path", "left_anti")
            rows = materialised(kept.unionByName(rows), name)  # read before its folders are replaced
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.folder}/{name}")

    def listing(self) -> DataFrame | None:
        """path, modified, size_bytes, error (null where the file was indexed), part."""
        return self._read("files")

    def chunks(self) -> DataFrame | None:
        """Chunks of the files as last listed; None before the first sync."""
        rows, known = self._read("chunks"), self.listing()
        return None if rows is None or known is None else rows.join(known.select("path", "modified"), ["path", "modified"], "left_semi")

    def sync(self) -> int:
        """Index what is new or changed; the number of such files."""
        found, known = files.listing(self.spark, self.root, *self.rules), self.listing()
        stamp = ["path", "modified", "size_bytes"]
        fresh = found.select(stamp) if known is None else found.select(stamp).join(known.select(stamp), stamp, "left_anti")
        fresh = materialised(fresh.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(PARTS)).cast("int")), "fresh")
        about = fresh.agg(F.count("*").alias("n"), F.collect_set("part").alias("parts")).first()
        if not about["n"]:
            return 0
        changed = files.with_content(fresh.drop("part"))
        rows = materialised(files.extracted(changed), "extract")
        e, _, errors = base.split(rows)
        made = chunking.chunk_code(graph.upsert(e), changed, self.settings.chunking).drop("ord")
        at = graph.upsert(e).select(F.col("id").alias("entity_id"), F.col("file").alias("path")).join(fresh.select("path", "modified", "part"), "path")
        self._rewrite("chunks", made.join(at, "entity_id"), fresh, about["parts"])
        failed = errors.groupBy("path").agg(F.min("error").alias("error"))
        self._rewrite("files", fresh.join(failed, "path", "left").select(*stamp, "error", "part"), fresh, about["parts"])
        return about["n"]

    def watch(self, checkpoint: str, every: str = "5 seconds") -> StreamingQuery:
        """A stream whose ticks sync; a sync that fails is logged and tried again at the next tick. Stop it by ``stop()``."""

        def tick(_: DataFrame, k: int) -> None:
            try:
                n = self.sync()
                LOG.info("tick %s: %s files indexed", k, n)
            except Exception:
                LOG.exception("tick %s failed", k)

        clock = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return clock.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
