"""Schemas and closed vocabularies of the property graph and of the retrieval index."""

from __future__ import annotations

from pyspark.sql import types as T

LOCATION = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("line_start", T.IntegerType()),
        T.StructField("line_end", T.IntegerType()),
        T.StructField("column_start", T.IntegerType()),
        T.StructField("column_end", T.IntegerType()),
    ]
)
_META = T.MapType(T.StringType(), T.StringType())

#: ``ord`` makes the order of insertion explicit; first matches and ties go by it.
ENTITY = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("qualified_name", T.StringType()),
        T.StructField("location", LOCATION),
        T.StructField("docstring", T.StringType()),
        T.StructField("signature", T.StringType()),
        T.StructField("source_code", T.StringType()),
        T.StructField("metadata", _META),
        T.StructField("ord", T.LongType()),
    ]
)
RELATIONSHIP = T.StructType(
    [
        T.StructField("source_id", T.StringType(), False),
        T.StructField("target_id", T.StringType(), False),
        T.StructField("kind", T.StringType()),
        T.StructField("metadata", _META),
        T.StructField("ord", T.LongType()),
    ]
)
CHUNK = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("entity_id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("metadata", _META),
        T.StructField("ord", T.LongType()),
    ]
)

#: Fixed values.
ENTITY_KINDS = ("module", "class", "function", "method", "variable", "document", "section", "config_key", "commit", "author", "test_run", "coverage_report")
RELATIONSHIP_KINDS = ("calls", "imports", "contains", "inherits", "references", "changed_by", "authored", "modified", "covers", "executed_by")
TASKS = ("explain", "debug", "extend", "review", "locate", "general")
REFERENCE, EXTERNAL = "ref::", "external::"
