"""Graph, usage and history views over the star-schema tables.

Entities: regions are modules, nations classes, customers and suppliers functions, orders
methods, parts variables. Edges: containment down the geography, calls from customers to
orders to parts to suppliers (a bag, one per line item), imports of market segments, and
inheritance by name, which has yet to be resolved.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import EXTERNAL, REFERENCE
from .runtime import spread

RANK = 10**12  # ord = rank of the table (or edge family) * RANK + key
_SCHEMAS: dict[tuple[str, float], StructType] = {}  # of local tables, by path and time of change


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; the schema of a local one is inferred by one job for all views that read it, a remote one's each time."""
    path = f"{sf_dir}/{name}.parquet"
    if not os.path.exists(path):
        return spark.read.parquet(path)
    at = (path, os.stat(path).st_mtime)
    if at not in _SCHEMAS:
        _SCHEMAS[at] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[at]).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, for work that costs much more than reading them."""
    return spread(table(spark, sf_dir, "documents"))


def key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(f"{prefix}::"), F.col(column).cast("string"))


def _numbered(entity_id: str) -> tuple[str, int | None]:
    """Table and key that an id names; the key is null where it is no number."""
    name, _, number = entity_id.partition("::")
    return name, int(number) if number.isdecimal() and str(int(number)) == number else None


def entities(spark: SparkSession, sf_dir: str, tables: set[str] | None = None, entity_id: str | None = None) -> DataFrame:
    """id, kind, name, qualified_name, file, line, docstring, signature, source_code, ord.

    ``tables`` keeps the branches of these tables only; ``entity_id`` the branch and, by a
    filter on its key column that reaches the scan, the row of that id.
    """
    number = None
    if entity_id is not None:
        name, number = _numbered(entity_id)
        tables = {name} if number is not None else set()

    def part(rank: int, name: str, kind: str, key_col: str, label: Column, bucket: str, doc: Column, source: Column) -> DataFrame | None:
        if tables is not None and name not in tables:
            return None
        rows = table(spark, sf_dir, name)
        if number is not None:
            rows = rows.filter(F.col(key_col) == number)
        return rows.select(
            key(name, key_col).alias("id"),
            F.lit(kind).alias("kind"),
            label.alias("name"),
            F.concat(F.lit(f"{name}."), label).alias("qualified_name"),
            F.concat(F.lit(f"{name}/"), F.col(bucket).cast("string")).alias("file"),
            F.col(key_col).cast("long").alias("line"),
            doc.alias("docstring"),
            F.concat(label, F.lit("()")).alias("signature"),
            source.alias("source_code"),
            (F.lit(rank * RANK) + F.col(key_col)).cast("long").alias("ord"),
        )

    none = F.lit(None).cast("string")
    parts = [
        part(0, "region", "module", "r_regionkey", F.col("r_name"), "r_name", none, none),
        part(1, "nation", "class", "n_nationkey", F.col("n_name"), "n_regionkey", none, none),
        part(2, "customer", "function", "c_custkey", F.col("c_name"), "c_mktsegment", F.concat(F.lit("Buys for "), F.lower("c_mktsegment")), F.concat(F.lit("return "), F.col("c_acctbal").cast("decimal(18,2)").cast("string"))),
        part(3, "supplier", "function", "s_suppkey", F.col("s_name"), "s_nationkey", none, F.concat(F.lit("return "), F.col("s_acctbal").cast("decimal(18,2)").cast("string"))),
        part(4, "orders", "method", "o_orderkey", F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")), "o_orderpriority", F.col("o_orderpriority"), none),
        part(5, "part", "variable", "p_partkey", F.col("p_name"), "p_brand", F.col("p_type"), none),
    ]
    kept = [p for p in parts if p is not None]
    return reduce(DataFrame.unionByName, kept) if kept else entities(spark, sf_dir, {"region"}).filter("false")


#: (kind, table read, source, target, order): ends are (table, key column), or a prefix and column that name no table.
_LINE = "l_orderkey * 8 + l_linenumber"
_EDGES = [
    ("contains", "nation", ("region", "n_regionkey"), ("nation", "n_nationkey"), "n_nationkey"),
    ("contains", "customer", ("nation", "c_nationkey"), ("customer", "c_custkey"), "c_custkey"),
    ("contains", "supplier", ("nation", "s_nationkey"), ("supplier", "s_suppkey"), "s_suppkey"),
    ("calls", "orders", ("customer", "o_custkey"), ("orders", "o_orderkey"), "o_orderkey"),
    ("calls", "lineitem", ("orders", "l_orderkey"), ("part", "l_partkey"), _LINE),
    ("calls", "lineitem", ("part", "l_partkey"), ("supplier", "l_suppkey"), _LINE),
    ("imports", "customer", ("customer", "c_custkey"), (EXTERNAL, "c_mktsegment"), "c_custkey"),
    ("inherits", "supplier", ("supplier", "s_suppkey"), (REFERENCE, "n_name"), "s_suppkey"),
    ("inherits", "part", ("part", "p_partkey"), (REFERENCE, "p_brand"), "p_partkey"),
]


def _far_tables(kinds: tuple[str, ...], near: str, anchor: str) -> set[str]:
    at = _numbered(anchor)[0]
    ends = [(s[0], t[0]) if near == "source_id" else (t[0], s[0]) for kind, _, s, t, _ in _EDGES if kind in kinds]
    return {far for close, far in ends if close == at and not far.endswith("::")}


def around(spark: SparkSession, sf_dir: str, near: str, anchor: str, kinds: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Edges of these kinds whose ``near`` end is the anchor, and the entities their other ends can be; other branches are not read."""
    return relationships(spark, sf_dir, near, anchor, kinds), entities(spark, sf_dir, _far_tables(kinds, near, anchor))


def relationships(spark: SparkSession, sf_dir: str, near: str | None = None, anchor: str | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """source_id, target_id, kind, ord; edges are kept as often as they occur.

    ``kinds`` keeps the branches of these kinds only; ``near`` and ``anchor`` those whose
    end on that side can be the anchor, by a filter on the key column that reaches the scan.
    """
    kept = []
    for rank, (kind, name, source, target, order) in enumerate(_EDGES):
        if kinds is not None and kind not in kinds:
            continue
        rows = table(spark, sf_dir, name)
        if kind == "inherits" and name == "supplier":
            rows = rows.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        if anchor is not None:
            prefix, column = source if near == "source_id" else target
            at, number = _numbered(anchor)
            if prefix.endswith("::"):
                if not anchor.startswith(prefix):
                    continue
                rows = rows.filter(F.col(column) == anchor.removeprefix(prefix))
            elif prefix != at or number is None:
                continue
            else:
                rows = rows.filter(F.col(column) == number)
        end = lambda e: F.concat(F.lit(e[0]), F.col(e[1])) if e[0].endswith("::") else key(*e)
        kept.append(rows.select(end(source).alias("source_id"), end(target).alias("target_id"), F.lit(kind).alias("kind"), (F.lit(rank * RANK) + F.expr(order)).cast("long").alias("ord")))
    return reduce(DataFrame.unionByName, kept) if kept else relationships(spark, sf_dir, kinds=("contains",)).filter("false")


def sources(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...]) -> DataFrame:
    """source_id, kind: the ids that edges of these kinds go out from, once for each family of edges.

    Families are made distinct by their key columns, so that numbers are dealt and compared
    and ids are made of what is left.
    """
    kept = []
    for kind, name, (prefix, column), _, _ in _EDGES:
        if kind in kinds:
            if kind == "inherits":
                raise ValueError("sources of inherits are not told from the table alone")
            kept.append(table(spark, sf_dir, name).select(column).distinct().select(key(prefix, column).alias("source_id"), F.lit(kind).alias("kind")))
    return reduce(DataFrame.unionByName, kept)


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entities to be chunked: entity_id, content, kind, has_docstring, ord."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = documents(spark, sf_dir).join(labels, "doc_id", "left")
    return docs.select(
        F.concat(F.lit("doc::"), F.col("doc_id").cast("string")).alias("entity_id"),
        F.coalesce("text", F.lit("")).alias("content"),
        F.col("lang").alias("kind"),
        F.when(F.col("quality") == 1, "true").otherwise("false").alias("has_docstring"),
        F.col("doc_id").cast("long").alias("ord"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each model: model, ts (timestamp), event_id."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("model"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value")


_E = """kg_entities AS (
 SELECT 'region::'||r_regionkey AS id, 'module' AS kind, r_name AS name, 'region.'||r_name AS qualified_name, 'region/'||r_name AS file, r_regionkey::BIGINT AS line, NULL::VARCHAR AS docstring, r_name||'()' AS signature, NULL::VARCHAR AS source_code, r_regionkey::BIGINT AS ord FROM region
 UNION ALL SELECT 'nation::'||n_nationkey, 'class', n_name, 'nation.'||n_name, 'nation/'||n_regionkey, n_nationkey, NULL, n_name||'()', NULL, 1000000000000+n_nationkey FROM nation
 UNION ALL SELECT 'customer::'||c_custkey, 'function', c_name, 'customer.'||c_name, 'customer/'||c_mktsegment, c_custkey, 'Buys for '||lower(c_mktsegment), c_name||'()', 'return '||c_acctbal::DECIMAL(18,2), 2000000000000+c_custkey FROM customer
 UNION ALL SELECT 'supplier::'||s_suppkey, 'function', s_name, 'supplier.'||s_name, 'supplier/'||s_nationkey, s_suppkey, NULL, s_name||'()', 'return '||s_acctbal::DECIMAL(18,2), 3000000000000+s_suppkey FROM supplier
 UNION ALL SELECT 'orders::'||o_orderkey, 'method', 'Order#'||o_orderkey, 'orders.Order#'||o_orderkey, 'orders/'||o_orderpriority, o_orderkey, o_orderpriority, 'Order#'||o_orderkey||'()', NULL, 4000000000000+o_orderkey FROM orders
 UNION ALL SELECT 'part::'||p_partkey, 'variable', p_name, 'part.'||p_name, 'part/'||p_brand, p_partkey, p_type, p_name||'()', NULL, 5000000000000+p_partkey FROM part)"""
_R = """kg_relationships AS (
 SELECT 'region::'||n_regionkey AS source_id, 'nation::'||n_nationkey AS target_id, 'contains' AS kind, n_nationkey::BIGINT AS ord FROM nation
 UNION ALL SELECT 'nation::'||c_nationkey, 'customer::'||c_custkey, 'contains', 1000000000000+c_custkey FROM customer
 UNION ALL SELECT 'nation::'||s_nationkey, 'supplier::'||s_suppkey, 'contains', 2000000000000+s_suppkey FROM supplier
 UNION ALL SELECT 'customer::'||o_custkey, 'orders::'||o_orderkey, 'calls', 3000000000000+o_orderkey FROM orders
 UNION ALL SELECT 'orders::'||l_orderkey, 'part::'||l_partkey, 'calls', 4000000000000+l_orderkey*8+l_linenumber FROM lineitem
 UNION ALL SELECT 'part::'||l_partkey, 'supplier::'||l_suppkey, 'calls', 5000000000000+l_orderkey*8+l_linenumber FROM lineitem
 UNION ALL SELECT 'customer::'||c_custkey, 'external::'||c_mktsegment, 'imports', 6000000000000+c_custkey FROM customer
 UNION ALL SELECT 'supplier::'||s_suppkey, 'ref::'||n_name, 'inherits', 7000000000000+s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT 'part::'||p_partkey, 'ref::'||p_brand, 'inherits', 8000000000000+p_partkey FROM part)"""
#: The same views for the SQL twins; more common table expressions may follow after a comma.
KG_SQL = f"WITH RECURSIVE {_E}, {_R}"
