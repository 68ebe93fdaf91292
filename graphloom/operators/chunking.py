"""Chunks of extracted code: module headers, imports, and windows of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Chunking
from ..functions import text as X
from . import retrieval

_QUOTES = "\"\"\"|'''"


def module_header(text: Column) -> Column:
    """Leading lines up to the first import, class or def, or to the end of the first docstring; blank lines outside it are left out."""
    lines = F.split(text, "\r?\n")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("inside"), F.lit(False).alias("done"))

    def step(acc: Column, line: Column) -> Column:
        bare = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
        quotes = F.size(F.split(bare, _QUOTES)) - 1
        code = bare.rlike(r"^(import |from |class |def )")
        stop = acc["done"] | (~acc["inside"] & (quotes == 0) & code)
        blank = ~acc["inside"] & (bare == "")
        closes = (quotes > 0) & (acc["inside"] | (quotes >= 2))
        return F.struct(
            F.when(stop | blank, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(line))).alias("kept"),
            F.when(stop | blank, acc["inside"]).otherwise((acc["inside"] | (quotes > 0)) & ~closes).alias("inside"),
            (stop | (~blank & closes)).alias("done"),
        )

    return F.regexp_replace(F.array_join(F.aggregate(lines, start, step)["kept"], "\n"), r"^\s+|\s+$", "")


def content(config: Chunking) -> Column:
    """Signature, docstring and source (or the name) of an entity."""
    bits = []
    if config.include_signatures:
        bits.append(F.when(F.coalesce("signature", F.lit("")) != "", F.col("signature")))
    if config.include_docstrings:
        bits.append(F.when(F.coalesce("docstring", F.lit("")) != "", F.concat(F.lit('"""'), F.col("docstring"), F.lit('"""'))))
    bits.append(F.when(F.coalesce("source_code", F.lit("")) != "", F.col("source_code")).otherwise(F.col("name")))
    return F.concat_ws("\n", *bits)


def chunk_code(entities: DataFrame, files: DataFrame, config: Chunking | None = None) -> DataFrame:
    """id, entity_id, content, tokens, type, kind, has_docstring, last_modified of all chunks of scanned files.

    Header and import chunks carry the id of the module entity, so that they lead back to it.
    """
    config = config or Chunking()
    text = files.select(F.col("path").alias("file"), F.col("content").cast("string").alias("text"), F.col("modified").cast("string").alias("last_modified"))
    modules = entities.filter("kind = 'module'").select(F.col("id").alias("entity_id"), "file").join(text, "file")

    def whole(kind: str, value: Column) -> DataFrame:
        made = modules.select(F.concat("file", F.lit(f"::{kind}::0")).alias("id"), "entity_id", value.alias("content"), F.lit("module_header" if kind == "module" else kind).alias("type"), F.lit("module").alias("kind"), F.lit("false").alias("has_docstring"), "last_modified")
        return made.filter("content <> ''")

    rows = entities.filter("kind <> 'module'").join(text.select("file", "last_modified"), "file", "left").select(F.col("id").alias("entity_id"), content(config).alias("content"), "kind", F.when(F.coalesce("docstring", F.lit("")) != "", "true").otherwise("false").alias("has_docstring"), "last_modified")
    windows = retrieval.chunk(rows, config.max_chars, config.overlap).select("id", "entity_id", "content", F.lit("code").alias("type"), "kind", "has_docstring", "last_modified")
    out = whole("module", module_header(F.col("text"))).unionByName(whole("imports", X.import_lines(F.col("text")))).unionByName(windows)
    return out.withColumn("tokens", X.tokenize(F.col("content"))).withColumn("ord", F.col("id"))


def embed(chunks: DataFrame, dimension: int = 256) -> DataFrame:
    """chunk vectors by signed hashing of tokens, normalised: a provider that needs no network."""
    each = chunks.select("id", F.explode("tokens").alias("t")).select("id", F.pmod(F.xxhash64("t"), F.lit(dimension)).cast("int").alias("at"), F.when(F.pmod(F.hash("t"), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("w"))
    cells = each.groupBy("id", "at").agg(F.sum("w").alias("w"))
    per = cells.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "w"))).alias("m"))
    v = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0)))
    return per.select("id", X.normalize(v).cast("array<float>").alias("embedding"))
