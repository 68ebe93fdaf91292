"""Lookups, joins, construction and traversal of the property graph.

Every operator takes the entity and relationship tables as DataFrames and returns one.
Edges are a bag: operators that list edges' ends give a row per edge, the ``dependencies``
family gives sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import materialised
from ..schema import REFERENCE


# --- lookups ---------------------------------------------------------------------------------


def get_entity(e: DataFrame, entity_id: str) -> DataFrame:
    return e.filter(F.col("id") == entity_id)


def _matches(pattern: str) -> Column:
    low = F.lit(pattern.lower())
    return F.contains(F.lower("name"), low) | F.contains(F.lower("qualified_name"), low)


def search(e: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    """Entities whose name or qualified name contains the pattern, in any case; ``%`` and ``_`` are literal."""
    found = e.filter(_matches(pattern))
    return found.orderBy("ord").limit(limit) if limit is not None else found


def by_kind(e: DataFrame, kind: str) -> DataFrame:
    """Entities of a kind; an unknown kind gives none."""
    return e.filter(F.col("kind") == kind)


def outgoing(r: DataFrame, entity_id: str) -> DataFrame:
    return r.filter(F.col("source_id") == entity_id)


def incoming(r: DataFrame, entity_id: str) -> DataFrame:
    return r.filter(F.col("target_id") == entity_id)


def imports(r: DataFrame, entity_id: str) -> DataFrame:
    """Imported ids, whether or not such entities exist."""
    return outgoing(r, entity_id).filter(F.col("kind") == "imports").select("target_id")


def resolve_target(e: DataFrame, target: str) -> DataFrame:
    """The entity with that id, else the first whose name contains the text; no rows if neither exists."""
    exact = e.filter(F.col("id") == target).withColumn("prio", F.lit(0))
    near = e.filter(_matches(target)).withColumn("prio", F.lit(1))
    return exact.unionByName(near).orderBy("prio", "ord").limit(1).drop("prio")


# --- joins ------------------------------------------------------------------------------------


def _ends(r: DataFrame, e: DataFrame, entity_id: str, kinds: tuple[str, ...], near: str, far: str) -> DataFrame:
    edges = r.filter((F.col(near) == entity_id) & F.col("kind").isin(*kinds)).select(F.col(far).alias("far_id"), F.col("ord").alias("edge_ord"))
    return edges.join(e, F.col("far_id") == F.col("id")).drop("far_id")


def callers(r: DataFrame, e: DataFrame, entity_id: str) -> DataFrame:
    return _ends(r, e, entity_id, ("calls",), "target_id", "source_id")


def callees(r: DataFrame, e: DataFrame, entity_id: str) -> DataFrame:
    return _ends(r, e, entity_id, ("calls",), "source_id", "target_id")


def children(r: DataFrame, e: DataFrame, entity_id: str) -> DataFrame:
    return _ends(r, e, entity_id, ("contains",), "source_id", "target_id")


def parents(r: DataFrame, e: DataFrame) -> DataFrame:
    """(child_id, parent_id) of every contained id: its first containing edge decides; null if that parent is unknown."""
    first = r.filter(F.col("kind") == "contains").groupBy(F.col("target_id").alias("child_id")).agg(F.min_by("source_id", "ord").alias("first_id"))
    return first.join(e.select(F.col("id").alias("parent_id")), F.col("first_id") == F.col("parent_id"), "left").select("child_id", "parent_id")


def dependencies(r: DataFrame, e: DataFrame, entity_id: str) -> DataFrame:
    """Existing entities that are called or imported, each once."""
    ids = outgoing(r, entity_id).filter(F.col("kind").isin("calls", "imports")).select(F.col("target_id").alias("id"))
    return e.join(ids, "id", "left_semi")


def dependents(r: DataFrame, e: DataFrame, entity_id: str) -> DataFrame:
    ids = incoming(r, entity_id).filter(F.col("kind").isin("calls", "imports")).select(F.col("source_id").alias("id"))
    return e.join(ids, "id", "left_semi")


def leaves(r: DataFrame, e: DataFrame) -> DataFrame:
    """Entities that call and contain nothing."""
    busy = r.filter(F.col("kind").isin("calls", "contains")).select(F.col("source_id").alias("id"))
    return e.join(busy, "id", "left_anti")


# --- construction -----------------------------------------------------------------------------


def upsert(e: DataFrame) -> DataFrame:
    """One row per id: the last value by ``ord``, at the first position."""
    value = F.struct(*[c for c in e.columns if c not in ("id", "ord")])
    return e.groupBy("id").agg(F.max_by(value, "ord").alias("v"), F.min("ord").alias("ord")).select("id", "v.*", "ord")


def name_keys(e: DataFrame) -> DataFrame:
    """(key, target): what a reference by name means. Exact names beat dotted suffixes, then the first entity wins."""
    named = e.select("id", "ord", F.explode(F.array(F.struct(F.col("name").alias("key"), F.lit(1).alias("prio")), F.struct(F.col("qualified_name").alias("key"), F.lit(1).alias("prio")))).alias("k")).select("id", "ord", "k.*")
    bits = F.split("qualified_name", r"\.")
    suffix = F.transform(F.sequence(F.lit(2), F.size(bits)), lambda k: F.array_join(F.slice(bits, k, F.size(bits)), "."))
    dotted = e.filter(F.contains("qualified_name", F.lit("."))).select("id", "ord", F.explode(suffix).alias("key"), F.lit(2).alias("prio"))
    return named.unionByName(dotted).groupBy("key").agg(F.min_by("id", F.struct("prio", "ord")).alias("target"))


def resolve(r: DataFrame, e: DataFrame) -> DataFrame:
    """Edges with ``ref::name`` targets rewritten to entity ids; those without a match stay as they are."""
    named = F.when(F.startswith("target_id", F.lit(REFERENCE)), F.substring("target_id", len(REFERENCE) + 1, 1 << 30))
    open_edges = r.withColumn("ref_name", named)
    found = open_edges.join(name_keys(e), F.col("ref_name") == F.col("key"), "left")
    return found.withColumn("target_id", F.coalesce("target", "target_id")).drop("ref_name", "key", "target")


def stats(e: DataFrame, r: DataFrame) -> DataFrame:
    """Flat (stat, n): totals and counts for each kind of entity and relationship."""

    def count(df: DataFrame, name: str) -> DataFrame:
        by = df.groupBy("kind").agg(F.count("*").alias("n")).select(F.concat(F.lit(f"{name}_"), "kind").alias("stat"), "n")
        return by.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(f"total_{name}").alias("stat"), "n"))

    return count(e, "entities").unionByName(count(r, "relationships"))


# --- traversal --------------------------------------------------------------------------------


def trace_calls(r: DataFrame, e: DataFrame, entity_id: str, direction: str = "callees", depth: int = 1, max_results: int | None = 50, strict_limit: bool = False) -> DataFrame:
    """Entities reached over calls: id, kind, qualified_name, file, line, call_depth (number of hops).

    Breadth first, each entity once, the start left out; ids without an entity are
    neither given nor followed. A node's calls are followed as long as fewer than
    ``max_results`` results are there, so the last one may exceed that, unless
    ``strict_limit``. Without a limit no order is kept and every hop is one join.
    """
    if direction not in ("callees", "callers"):
        raise ValueError(f"direction must be callees or callers, not {direction}")
    depth = max(1, depth)
    spark = e.sparkSession
    near, far = ("source_id", "target_id") if direction == "callees" else ("target_id", "source_id")
    edges = r.filter(F.col("kind") == "calls").select(F.col(near).alias("near"), F.col(far).alias("far"), "ord")
    known = e.select(F.col("id").alias("far"))
    frontier = spark.range(1).select(F.lit(entity_id).alias("id"), F.col("id").alias("pos"))
    visited = frontier.select(F.col("id").alias("far"))
    levels, total = [], 0
    for hop in range(1, depth + 1):
        # what a hop reaches is written before it meets the entities: its size is then known, so few ids are sent to the scan and no entity is shuffled
        step = edges.join(frontier, F.col("near") == F.col("id")).groupBy("far").agg(F.min(F.struct("pos", "ord")).alias("at"))
        step = materialised(step.join(visited, "far", "left_anti"), "step")
        found = materialised(known.join(step, "far").dropDuplicates(["far"]).select("far", "at.pos", "at.ord"), "trace")
        if max_results is not None:
            cut, n = None, total
            for row in found.groupBy("pos").agg(F.count("*").alias("n")).orderBy("pos").limit(max_results + 1).collect():  # a row for each node followed
                if n >= max_results:
                    break
                cut, n = row["pos"], n + row["n"]
            found = found.filter(F.col("pos") <= (cut if cut is not None else -1))
            total = n
        levels.append(found.select(F.col("far").alias("id"), "pos", "ord", F.lit(hop).alias("call_depth")))
        if hop == depth or max_results is not None and total >= max_results or found.isEmpty():
            break
        order = F.row_number().over(Window.orderBy("pos", "ord", "far")) if max_results is not None else F.lit(0)  # fewer than max_results rows
        frontier = found.select(F.col("far").alias("id"), order.cast("long").alias("pos"))
        visited = visited.union(found.select("far"))
    out = levels[0]
    for more in levels[1:]:
        out = out.union(more)
    if strict_limit and max_results is not None:
        out = out.orderBy("call_depth", "pos", "ord", "id").limit(max_results)
    return out.drop("pos", "ord").join(e.select("id", "kind", "qualified_name", "file", "line"), "id").select("id", "kind", "qualified_name", "file", "line", "call_depth")


def impact(r: DataFrame, e: DataFrame, entity_id: str, max_depth: int = 3, cap: int = 100) -> DataFrame:
    """One row: direct and transitive dependents, files affected and a risk score of 0 to 1.

    Risk is the mean of breadth (20 dependents, transitive ones at half, make 1), spread
    (5 files make 1) and the kind of the entity. An unknown id has zero counts and risk.
    """
    # the first hop follows one node, so no limit cuts it and it holds all direct dependents
    per = trace_calls(r, e, entity_id, "callers", max_depth, cap).select("file", (F.col("call_depth") == 1).cast("int").alias("direct"))
    sums = per.agg(F.coalesce(F.sum("direct"), F.lit(0)).alias("n_direct"), F.coalesce(F.sum(1 - F.col("direct")), F.lit(0)).alias("n_transitive"), F.sort_array(F.collect_set("file")).alias("files"))
    kinds = e.filter(F.col("id") == entity_id).agg(F.max("kind").alias("kind"))
    breadth = F.least(F.lit(1.0), (F.col("n_direct") + F.col("n_transitive") * 0.5) / 20)
    spread = F.least(F.lit(1.0), F.size("files") / 5)
    weight = F.when(F.col("kind") == "class", 0.6).when(F.col("kind") == "module", 0.8).otherwise(0.3)
    risk = F.when(F.col("kind").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.round((breadth + spread + weight) / 3, 2)))
    known = F.col("kind").isNotNull()
    return sums.join(kinds).select(
        F.lit(entity_id).alias("entity_id"),
        F.when(known, F.col("n_direct")).otherwise(0).cast("long").alias("direct_dependents"),
        F.when(known, F.col("n_transitive")).otherwise(0).cast("long").alias("transitive_dependents"),
        F.when(known, F.array_join("files", ",")).otherwise("").alias("affected_files"),
        risk.alias("risk_score"),
    )
