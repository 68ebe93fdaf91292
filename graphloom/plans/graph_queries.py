"""Graph queries: lookups, joins, construction, traversal, history, usage and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context, export, graph, history
from . import views
from .views import KG_SQL, around, entities, key, relationships, table

PART, CUSTOMER, NOW = "part::0", "customer::0", "2024-01-31"
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_ROW = "id, kind, name, qualified_name, file, line"
_COLS = [c.strip() for c in _ROW.split(",")]


@query(f"{KG_SQL} SELECT {_ROW}, docstring, signature, source_code FROM kg_entities WHERE id = '{CUSTOMER}'")
def get_entity(spark: SparkSession, d: str) -> DataFrame:
    return graph.get_entity(entities(spark, d, entity_id=CUSTOMER), CUSTOMER).select(*_COLS, "docstring", "signature", "source_code")


@query(f"{KG_SQL} SELECT {_ROW} FROM kg_entities WHERE contains(lower(name), 'an') OR contains(lower(qualified_name), 'an')")
def search_substring(spark, d):
    return graph.search(entities(spark, d), "AN").select(*_COLS)


@query(f"{KG_SQL} SELECT {_ROW} FROM kg_entities WHERE contains(lower(name), 'supplier') OR contains(lower(qualified_name), 'supplier') ORDER BY ord LIMIT 10")
def search_first_ten(spark, d):
    return graph.search(entities(spark, d), "Supplier", 10).select(*_COLS)


@query(f"{KG_SQL} SELECT {_ROW} FROM kg_entities WHERE kind = 'class'")
def entities_by_kind(spark, d):
    return graph.by_kind(entities(spark, d), "class").select(*_COLS)


@query(f"{KG_SQL} SELECT target_id, kind, ord FROM kg_relationships WHERE source_id = '{CUSTOMER}'")
def outgoing(spark, d):
    return graph.outgoing(relationships(spark, d, "source_id", CUSTOMER), CUSTOMER).select("target_id", "kind", "ord")


@query(f"{KG_SQL} SELECT source_id, kind, ord FROM kg_relationships WHERE target_id = '{PART}'")
def incoming(spark, d):
    return graph.incoming(relationships(spark, d, "target_id", PART), PART).select("source_id", "kind", "ord")


@query(f"""{KG_SQL} SELECT {_ROW} FROM (SELECT *, 0 AS prio FROM kg_entities WHERE id = 'order#1'
 UNION ALL SELECT *, 1 FROM kg_entities WHERE contains(lower(name), 'order#1') OR contains(lower(qualified_name), 'order#1')) ORDER BY prio, ord LIMIT 1""")
def resolve_target(spark, d):
    return graph.resolve_target(entities(spark, d), "order#1").select(*_COLS)


def _edge_sql(kind: str, near: str, far: str, anchor: str) -> str:
    return f"{KG_SQL} SELECT e.id, e.qualified_name AS name, e.file, r.ord AS edge_ord FROM kg_relationships r JOIN kg_entities e ON r.{far} = e.id WHERE r.kind = '{kind}' AND r.{near} = '{anchor}'"


def _listed(df: DataFrame) -> DataFrame:
    return df.select("id", F.col("qualified_name").alias("name"), "file", "edge_ord")


@query(_edge_sql("calls", "target_id", "source_id", PART))
def callers(spark, d):
    return _listed(graph.callers(*around(spark, d, "target_id", PART, ("calls",)), PART))


@query(_edge_sql("calls", "source_id", "target_id", PART))
def callees(spark, d):
    return _listed(graph.callees(*around(spark, d, "source_id", PART, ("calls",)), PART))


@query(_edge_sql("contains", "source_id", "target_id", "nation::3"))
def children(spark, d):
    return _listed(graph.children(*around(spark, d, "source_id", "nation::3", ("contains",)), "nation::3"))


@query(f"""{KG_SQL}, f AS (SELECT target_id AS child_id, arg_min(source_id, ord) AS first_id FROM kg_relationships WHERE kind = 'contains' GROUP BY 1)
 SELECT child_id, e.id AS parent_id FROM f LEFT JOIN kg_entities e ON f.first_id = e.id""")
def parent(spark, d):
    return graph.parents(relationships(spark, d, kinds=("contains",)), entities(spark, d))


@query(f"{KG_SQL} SELECT target_id FROM kg_relationships WHERE kind = 'imports' AND source_id = '{CUSTOMER}'")
def imports(spark, d):
    return graph.imports(relationships(spark, d, "source_id", CUSTOMER, ("imports",)), CUSTOMER)


@query(f"{KG_SQL} SELECT {_ROW} FROM kg_entities WHERE id IN (SELECT target_id FROM kg_relationships WHERE kind IN ('calls','imports') AND source_id = '{CUSTOMER}')")
def dependencies(spark, d):
    return graph.dependencies(*around(spark, d, "source_id", CUSTOMER, ("calls", "imports")), CUSTOMER).select(*_COLS)


@query(f"{KG_SQL} SELECT {_ROW} FROM kg_entities WHERE id IN (SELECT source_id FROM kg_relationships WHERE kind IN ('calls','imports') AND target_id = '{PART}')")
def dependents(spark, d):
    return graph.dependents(*around(spark, d, "target_id", PART, ("calls", "imports")), PART).select(*_COLS)


@query(f"{KG_SQL} SELECT id, kind FROM kg_entities e WHERE NOT EXISTS (SELECT 1 FROM kg_relationships r WHERE r.kind IN ('calls','contains') AND r.source_id = e.id)")
def leaf_entities(spark, d):
    return graph.leaves(views.sources(spark, d, ("calls", "contains")), entities(spark, d)).select("id", "kind")


@query("SELECT 'customer::'||o_custkey AS id, arg_max(o_totalprice, o_orderkey) AS value, min(o_orderkey) AS ord FROM orders GROUP BY 1")
def upsert_entities(spark, d):
    return graph.upsert(table(spark, d, "orders").select(key("customer", "o_custkey").alias("id"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("ord")))


@query(f"""{KG_SQL}, k AS (SELECT name AS key, 1 AS prio, ord, id FROM kg_entities UNION ALL SELECT qualified_name, 1, ord, id FROM kg_entities
 UNION ALL SELECT array_to_string(list_slice(string_split(qualified_name, '.'), i, 99), '.'), 2, ord, id FROM kg_entities, generate_series(2, 20) g(i) WHERE i <= len(string_split(qualified_name, '.'))),
 b AS (SELECT key, arg_min(id, (prio, ord)) AS target FROM k GROUP BY key)
 SELECT source_id, kind, coalesce(target, target_id) AS target_id, r.ord FROM kg_relationships r LEFT JOIN b ON starts_with(r.target_id, 'ref::') AND b.key = substr(r.target_id, 6) WHERE kind = 'inherits'""")
def resolve_references(spark, d):
    r = relationships(spark, d, kinds=("inherits",))
    return graph.resolve(r, entities(spark, d)).select("source_id", "kind", "target_id", "ord")


@query(f"""{KG_SQL} SELECT 'entities_'||kind AS stat, count(*) AS n FROM kg_entities GROUP BY kind UNION ALL SELECT 'total_entities', count(*) FROM kg_entities
 UNION ALL SELECT 'relationships_'||kind, count(*) FROM kg_relationships GROUP BY kind UNION ALL SELECT 'total_relationships', count(*) FROM kg_relationships""")
def graph_stats(spark, d):
    return graph.stats(entities(spark, d), relationships(spark, d))


def _trace_sql(near: str, far: str, start: str, depth: int) -> str:
    return f"""{KG_SQL}, t(id, call_depth) AS (SELECT '{start}', 0 UNION SELECT r.{far}, t.call_depth + 1 FROM t JOIN kg_relationships r ON r.{near} = t.id AND r.kind = 'calls' JOIN kg_entities x ON x.id = r.{far} WHERE t.call_depth < {depth})
 SELECT e.id, e.kind, e.qualified_name, e.file, e.line, min(t.call_depth) AS call_depth FROM t JOIN kg_entities e ON e.id = t.id WHERE e.id <> '{start}' GROUP BY ALL"""


@query(_trace_sql("source_id", "target_id", CUSTOMER, 3))
def trace_callees_d3(spark, d):
    return graph.trace_calls(relationships(spark, d, kinds=("calls",)), entities(spark, d), CUSTOMER, "callees", 3, None)


@query(_trace_sql("source_id", "target_id", CUSTOMER, 6))
def trace_callees_d6(spark, d):
    return graph.trace_calls(relationships(spark, d, kinds=("calls",)), entities(spark, d), CUSTOMER, "callees", 6, None)


@query(_trace_sql("target_id", "source_id", PART, 2))
def trace_callers_d2(spark, d):
    return graph.trace_calls(relationships(spark, d, kinds=("calls",)), entities(spark, d), PART, "callers", 2, 1000)


@query(f"""{KG_SQL}, t(id, n) AS (SELECT '{PART}', 0 UNION SELECT r.source_id, t.n + 1 FROM t JOIN kg_relationships r ON r.target_id = t.id AND r.kind = 'calls' JOIN kg_entities x ON x.id = r.source_id WHERE t.n < 3),
 m AS (SELECT t.id, min(n) AS n, any_value(file) AS file FROM t JOIN kg_entities e ON e.id = t.id WHERE t.id <> '{PART}' GROUP BY t.id),
 s AS (SELECT count(*) FILTER (n = 1) AS a, count(*) FILTER (n > 1) AS b, count(DISTINCT file) AS f, string_agg(DISTINCT file, ',' ORDER BY file) AS files FROM m)
 SELECT '{PART}' AS entity_id, a AS direct_dependents, b AS transitive_dependents, files AS affected_files, round((least(1.0, (a + b * 0.5) / 20) + least(1.0, f / 5) + 0.3) / 3, 2) AS risk_score FROM s""")
def impact(spark, d):
    return graph.impact(relationships(spark, d, kinds=("calls",)), entities(spark, d), PART)


# --- history: orders are commits, their customers the authors, line items the changes ----------------


def _commits(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("ts"))


def _authors(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("commit_id"), F.col("c_name").alias("author_name"), F.col("o_orderkey").alias("ord"))


def _modified(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit_id"), key("part", "l_partkey").alias("entity_id"), F.col("l_quantity").alias("insertions"), F.lit(0.0).alias("deletions"))


@query("SELECT o_orderkey AS commit_id, o_orderdate AS ts, coalesce(c_name, 'Unknown') AS author_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def recent_commits(spark, d):
    return history.recent_commits(_commits(spark, d), _authors(spark, d))


@query("SELECT l_orderkey AS commit_id, o_orderdate AS ts, l_quantity AS insertions, 0.0::DOUBLE AS deletions FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey = 0")
def entity_history(spark, d):
    return history.entity_history(_modified(spark, d), _commits(spark, d), PART)


@query("SELECT c_name AS author_name, count(DISTINCT l_orderkey) AS n_commits, count(DISTINCT l_partkey) AS n_files, sum(l_quantity) AS insertions FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def modified_by_author(spark, d):
    return history.modified_by_author(_modified(spark, d), _authors(spark, d))


#: Log lines of the orders: one in four without a type, one in ten cut short.
_LINES = """concat_ws('|', 'c' || o_orderkey, 'a' || o_custkey, '2024-01-01', CASE o_orderkey % 4 WHEN 0 THEN 'tidy up' WHEN 1 THEN 'fix: rank | order ' || o_orderkey WHEN 2 THEN 'feat(p' || o_custkey % 7 || '): add ' || o_orderpriority ELSE 'docs(): ' || o_orderstatus END)"""
_SUBJECT = "trim(CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE array_to_string(string_split(v, '|')[4:], '|') END)"
_TYPED = r"'^(\w+)(?:\(([^)]*)\))?:\s*(.*)$'"
_PARSED = f"""p AS (SELECT o_orderkey, string_split(v, '|') AS b, {_SUBJECT} AS s FROM (SELECT o_orderkey, {_LINES} AS v FROM orders)),
 c AS (SELECT b[1] AS sha, b[2] AS author, CASE WHEN regexp_matches(s, {_TYPED}) THEN regexp_extract(s, {_TYPED}, 1) ELSE 'other' END AS type, CASE WHEN regexp_matches(s, {_TYPED}) THEN regexp_extract(s, {_TYPED}, 2) ELSE '' END AS scope, CASE WHEN regexp_matches(s, {_TYPED}) THEN regexp_extract(s, {_TYPED}, 3) ELSE s END AS description FROM p WHERE s IS NOT NULL)"""


def _log(spark, d):
    line = F.expr(_LINES)
    cut = F.when(F.col("o_orderkey") % 10 == 9, F.concat(F.lit("c"), "o_orderkey", F.lit("|short"))).otherwise(line)
    return history.parse_commits(table(spark, d, "orders").select(cut.alias("value")))


@query(f"WITH {_PARSED} SELECT * FROM c")
def commit_lines(spark, d):
    return _log(spark, d).select("sha", "author", "type", "scope", "description")


@query(f"WITH {_PARSED} SELECT type, count(*) AS n, string_agg(description, '; ' ORDER BY description) AS descriptions FROM c WHERE author = 'a1' GROUP BY type")
def changelog_groups(spark, d):
    """The changelog of one author's commits."""
    return history.changelog(_log(spark, d).filter("author = 'a1'"))


@query("""WITH t AS (SELECT source, lang, sum(quality) AS c, count(*) AS v FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)
 SELECT source, lang, c::BIGINT || '/' || v AS hits, round(c / v, 4) AS line_rate, CASE WHEN c / v >= 1 THEN 'high' WHEN c / v >= 0.6 THEN 'medium' ELSE 'low' END AS level FROM t""")
def coverage_by_source(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("source", "lang", F.col("quality").alias("covered"))
    return history.coverage(rows, "source", "lang")


# --- usage limits ----------------------------------------------------------------------------------


def _window_sql(column: str, seconds: int) -> str:
    return f"SELECT event_id, user_id::VARCHAR AS model, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {seconds * 1_000_000 - 1} PRECEDING AND 1 PRECEDING) AS {column} FROM events"


@query(_window_sql("in_minute", 60))
def usage_60s(spark, d):
    return history.usage_counts(views.usage(spark, d)).select("event_id", "model", "in_minute")


@query(_window_sql("in_day", 86_400))
def usage_24h(spark, d):
    return history.usage_counts(views.usage(spark, d)).select("event_id", "model", "in_day")


@query("""WITH t AS (SELECT user_id::VARCHAR AS model, epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts) AS age FROM events WHERE ts < TIMESTAMP '2024-01-20'),
 c AS (SELECT model, count(*) FILTER (age < 60000000) AS in_minute, count(*) FILTER (age < 86400000000) AS in_day FROM t GROUP BY 1) SELECT *, in_minute < 10 AND in_day < 3 AS available FROM c""")
def availability(spark, d):
    return history.availability(views.usage(spark, d).filter("ts < timestamp '2024-01-20'"), "2024-01-20", rpd=3)


@query(f"SELECT event_id, user_id::VARCHAR AS model FROM events WHERE epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) < 86400000000")
def prune_24h(spark, d):
    return history.prune(views.usage(spark, d), NOW).select("event_id", "model")


# --- context and export -----------------------------------------------------------------------------


@query(f"""{KG_SQL}, x AS (SELECT r.target_id AS id, '- `' || e.qualified_name || '` - `' || split_part(e.signature, '(', 1) || '(...)`' AS n, row_number() OVER (PARTITION BY r.target_id ORDER BY r.ord, e.id) AS k, count(*) OVER (PARTITION BY r.target_id) AS total FROM kg_relationships r JOIN kg_entities e ON e.id = r.source_id WHERE r.kind = 'calls')
 SELECT id, '## Called By' || chr(10) || chr(10) || string_agg(n, chr(10) ORDER BY k) FILTER (k <= 10) || CASE WHEN any_value(total) > 10 THEN chr(10) || '- ... and ' || (any_value(total) - 10) || ' more' ELSE '' END AS callers FROM x GROUP BY id""")
def format_callers(spark, d):
    return context.callers_listing(entities(spark, d), relationships(spark, d))


@query(f"""{KG_SQL} SELECT '## ' || file || chr(10) || string_agg('- ' || kind || ' ' || qualified_name || CASE WHEN coalesce(docstring, '') <> '' THEN ': ' || docstring ELSE '' END, chr(10) ORDER BY line, ord) AS markdown, file FROM kg_entities WHERE kind IN ('function','class','method') GROUP BY file""")
def export_index(spark, d):
    return export.markdown_index(entities(spark, d))


@query(f"""{KG_SQL} SELECT '{{"source_id":"' || source_id || '","target_id":"' || target_id || '","kind":"' || kind || '"}}' AS json FROM kg_relationships""")
def relationships_json(spark, d):
    return export.relationship_json(relationships(spark, d))
