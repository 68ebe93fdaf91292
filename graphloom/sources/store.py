"""The knowledge store: Parquet for use, one JSON document for exchange, and the index with its manifest."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ENTITY_KINDS, RELATIONSHIP_KINDS

VERSION = "1.0"
_ENTITY = "struct<id:string,kind:string,name:string,qualified_name:string,location:struct<file_path:string,line_start:int,line_end:int,column_start:int,column_end:int>,docstring:string,signature:string,source_code:string,metadata:map<string,string>>"
_EDGE = "struct<source_id:string,target_id:string,kind:string,metadata:map<string,string>>"


def save(entities: DataFrame, relationships: DataFrame, path: str, errors: DataFrame | None = None) -> None:
    """Parquet; edges are partitioned by kind, which nearly every graph query filters on. Errors of the build are kept beside."""
    entities.write.mode("overwrite").parquet(f"{path}/entities")
    relationships.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/relationships")
    if errors is not None:
        errors.write.mode("overwrite").parquet(f"{path}/errors")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/relationships")


def load_errors(spark: SparkSession, path: str) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/errors")
    return spark.read.parquet(where.toString()) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


def load_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A store in the exchange form. Unknown kinds raise; order in the file becomes ``ord``."""
    raw = spark.read.schema(f"version string, entities map<string,{_ENTITY}>, relationships array<{_EDGE}>").json(path, multiLine=True)
    e = raw.select(F.posexplode(F.map_values("entities")).alias("ord", "e")).select("e.*", F.col("ord").cast("long").alias("ord"))
    e = e.withColumn("kind", _checked("kind", ENTITY_KINDS)).withColumn("file", F.col("location.file_path")).withColumn("line", F.col("location.line_start").cast("long"))
    r = raw.select(F.posexplode("relationships").alias("ord", "r")).select("r.*", F.col("ord").cast("long").alias("ord"))
    return e, r.withColumn("kind", _checked("kind", RELATIONSHIP_KINDS))


def _checked(column: str, allowed: tuple[str, ...]):
    return F.when(F.col(column).isin(*allowed), F.col(column)).otherwise(F.raise_error(F.concat(F.lit("unknown kind: "), F.coalesce(F.col(column), F.lit("null")))))


def export_json(entities: DataFrame, relationships: DataFrame, path: str, errors: DataFrame | None = None) -> None:
    """The exchange form as lines of JSON, one object per entity, edge or error, so that no task holds the whole store."""
    out = None
    for kind, rows in (("entity", entities), ("relationship", relationships), ("error", errors)):
        if rows is not None:
            lines = rows.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*rows.columns).alias("value"))).alias("value"))
            out = lines if out is None else out.unionByName(lines)
    out.write.mode("overwrite").text(path)


def load_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, relationships and errors that ``export_json`` wrote; unknown kinds raise. ``ord`` sorts as it did before."""
    raw = spark.read.schema("type string, value string").json(path)
    plain = "id string, kind string, name string, qualified_name string, file string, line long, docstring string, signature string, source_code string, metadata map<string,string>, ord string"
    edge = "source_id string, target_id string, kind string, metadata map<string,string>, ord string"

    def rows(kind: str, schema: str) -> DataFrame:
        return raw.filter(F.col("type") == kind).select(F.from_json("value", schema).alias("v")).select("v.*")

    at = F.from_json("ord", "path string, seq long")
    place = F.struct(F.coalesce(at["path"], F.lit("")).alias("path"), F.coalesce(at["seq"], F.col("ord").try_cast("long")).alias("seq"))
    e = rows("entity", plain).withColumn("kind", _checked("kind", ENTITY_KINDS)).withColumn("ord", place)
    r = rows("relationship", edge).withColumn("kind", _checked("kind", RELATIONSHIP_KINDS)).withColumn("ord", place)
    return e, r, rows("error", "path string, error string")


def manifest(provider: str, model: str, dimension: int, normalize: bool, size: int = 1000, overlap: int = 100) -> dict:
    return {"version": 1, "created_at": int(time.time()), "embedding": {"provider": provider, "model": model, "dimension": dimension, "normalize": normalize}, "chunking": {"max_chars": size, "overlap": overlap}}


def save_index(chunks: DataFrame, vectors: DataFrame, about: dict, path: str) -> None:
    """Chunks without their vectors, vectors by chunk id, and the manifest."""
    spark = chunks.sparkSession
    chunks.drop("embedding").write.mode("overwrite").parquet(f"{path}/chunks")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_index(spark: SparkSession, path: str, expected: dict | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Chunks, vectors and manifest; raises if the manifest does not fit what is expected of the embedding."""
    about = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    for k, v in (expected or {}).items():
        if about["embedding"].get(k) != v:
            raise ValueError(f"index was built with {k}={about['embedding'].get(k)!r}, not {v!r}")
    return spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/vectors"), about
