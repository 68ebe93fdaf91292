import pytest

from graphloom.operators import context, graph, history, retrieval

E = "id string, kind string, name string, qualified_name string, file string, line long, docstring string, signature string, source_code string, ord long"
R = "source_id string, target_id string, kind string, ord long"


@pytest.fixture(scope="module")
def tables(spark):
    ids = "a b c d e f".split()
    e = spark.createDataFrame([(i, "class" if i == "a" else "function", i.upper(), f"m.{i.upper()}", f"f{k % 3}", k, None, None, None, k) for k, i in enumerate(ids)], E)
    calls = [("a", "b"), ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "d"), ("d", "missing"), ("missing", "e"), ("d", "f")]
    r = spark.createDataFrame([(s, t, "calls", k) for k, (s, t) in enumerate(calls)] + [("x", "b", "contains", 20), ("a", "b", "contains", 21)], R)
    return e, r


def ids(df):
    return sorted((r.id, r.call_depth) for r in df.collect())


def test_trace(tables):
    e, r = tables
    assert ids(graph.trace_calls(r, e, "a")) == [("b", 1), ("c", 1)]
    for most in (None, 50):
        assert ids(graph.trace_calls(r, e, "a", depth=5, max_results=most)) == [("b", 1), ("c", 1), ("d", 2), ("f", 3)]
        assert ids(graph.trace_calls(r, e, "d", "callers", 2, most)) == [("a", 2), ("b", 1), ("c", 1)]
    # the node that reaches the limit is finished; the next one is not followed
    assert ids(graph.trace_calls(r, e, "a", depth=3, max_results=1)) == [("b", 1), ("c", 1)]
    assert ids(graph.trace_calls(r, e, "a", depth=3, max_results=3)) == [("b", 1), ("c", 1), ("d", 2)]
    assert len(ids(graph.trace_calls(r, e, "a", depth=3, max_results=1, strict_limit=True))) == 1
    assert ids(graph.trace_calls(r, e, "missing")) == [("e", 1)]  # the start need not exist
    with pytest.raises(ValueError):
        graph.trace_calls(r, e, "a", "sideways")


def test_bags_sets_and_first_parent(tables):
    e, r = tables
    assert [x.id for x in graph.callers(r, e, "b").collect()] == ["a", "a"]
    assert [x.id for x in graph.dependents(r, e, "b").collect()] == ["a"]
    assert {(x.child_id, x.parent_id) for x in graph.parents(r, e).collect()} == {("b", None)}


def test_impact(tables):
    e, r = tables
    x = graph.impact(r, e, "a").first()
    assert (x.direct_dependents, x.transitive_dependents) == (1, 2)
    assert x.risk_score == round((2 / 20 + 3 / 5 + 0.6) / 3, 2)
    assert graph.impact(r, e, "nothing").first().risk_score == 0.0


def test_upsert_and_resolution(spark):
    e = spark.createDataFrame([("f::A", "class", "A", "A", "f", 1, "old", None, None, 0), ("f::B", "class", "x", "p.q.B", "f", 2, None, None, None, 1), ("f::A", "class", "A", "A", "f", 9, "new", None, None, 2), ("g::B", "class", "B", "B", "g", 1, None, None, None, 3)], E)
    one = {r.id: (r.docstring, r.line, r.ord) for r in graph.upsert(e).collect()}
    assert one["f::A"] == ("new", 9, 0) and len(one) == 3
    r = spark.createDataFrame([("s", f"ref::{t}", "calls", k) for k, t in enumerate(["A", "B", "q.B", "p.q.B", "none"])] + [("s", "external::A", "imports", 9)], R)
    got = [x.target_id for x in graph.resolve(r, graph.upsert(e)).orderBy("ord").collect()]
    assert got == ["f::A", "g::B", "f::B", "f::B", "ref::none", "external::A"]


def test_search_is_literal(tables, spark):
    e, _ = tables
    assert graph.search(e, "").count() == 6 and graph.search(e, "%").count() == 0 and graph.search(e, "m.a").count() == 1
    assert graph.resolve_target(e, "B").first().id == "b" and graph.resolve_target(e, "zzz").count() == 0


def test_chunk_boundaries(spark):
    for n, want in ((0, 1), (1, 1), (1000, 1), (1001, 2), (1900, 2), (1901, 3)):
        rows = retrieval.chunk(spark.createDataFrame([("x", "a" * n)], "entity_id string, content string")).orderBy("chunk_index").collect()
        assert len(rows) == want and len(rows[-1].content) == n - 900 * (want - 1)
    with pytest.raises(ValueError):
        retrieval.chunk(spark.createDataFrame([("x", "a")], "entity_id string, content string"), 10, 10)


def test_fusion_extremes_and_ties(spark):
    s = spark.createDataFrame([(1, "c1", 1), (1, "c2", 2)], "qid int, id string, rank int")
    d = spark.createDataFrame([(1, "c2", 1), (1, "c1", 2)], "qid int, id string, rank int")
    first = lambda a: [r.id for r in retrieval.fuse(s, d, 2, a).orderBy("rank").collect()]
    assert first(0.0) == ["c1", "c2"] and first(1.0) == ["c2", "c1"] and first(0.5) == ["c1", "c2"]


def test_expansion_keeps_first_occurrence(spark):
    hits = spark.createDataFrame([(1, "c1", 0.9, 1), (1, "c2", 0.8, 2)], "qid int, id string, score double, rank int")
    chunks = spark.createDataFrame([("c1", "e1", 1), ("c2", "e2", 2)], "id string, entity_id string, ord long")
    calls = spark.createDataFrame([("e1", "e2", 0)], "source_id string, target_id string, ord long")
    got = [(r.id, r.source, r.score) for r in retrieval.expand(hits, chunks, calls).orderBy("rank").collect()]
    assert got == [("c1", "retrieved", 0.9), ("c2", "dependency", 0.0)]
    assert [r.entity_id for r in retrieval.distinct_entities(retrieval.expand(hits, chunks, calls), 2).collect()] == ["e1"]


def test_rerank_boosts(spark):
    hits = spark.createDataFrame([(1, c, 1.0, k) for k, c in enumerate("abcd", 1)], "qid int, id string, score double, rank int")
    chunks = spark.createDataFrame([("a", "x", "f", "false", None), ("b", "x", "f", "TRUE", "bad"), ("c", "say Hello you", "f", "false", "2024-01-30"), ("d", "x", "hello", "false", "2023-01-30")], "id string, content string, kind string, has_docstring string, last_modified string")
    q = spark.createDataFrame([(1, "hello")], "qid int, text string")
    got = {r.id: round(r.score, 3) for r in retrieval.rerank(hits, q, chunks, None, "2024-01-31").collect()}
    assert got == {"a": 1.0, "b": 1.2, "c": 1.65, "d": 2.0}


def test_limits_are_strict(spark):
    u = spark.createDataFrame([("m", f"2024-01-01 00:0{k}:00") for k in range(3)], "model string, ts string").selectExpr("model", "timestamp(ts) ts")
    assert [r.in_minute for r in history.usage_counts(u).orderBy("ts").collect()] == [0, 0, 0]  # exactly 60 s apart
    s = history.availability(u, "2024-01-01 00:03:00", rpm=1, rpd=3).first()
    assert (s.in_minute, s.in_day, s.available) == (0, 3, False)
    models = spark.createDataFrame([("m", 1), ("n", 2)], "model string, priority int")
    assert history.first_available(models, history.availability(u, "2024-01-01 00:03:00", 1, 3)).first().model == "n"


def test_context(spark):
    e = spark.createDataFrame([("a", "function", "a", "m.a", "f", 1, "Doc " * 20, "def a()", "x = 1 " * 2000, 0)] + [(f"c{k:02d}", "function", "c", f"m.c{k:02d}", "f", k, None, None, None, k) for k in range(1, 13)], E)
    r = spark.createDataFrame([(f"c{k:02d}", "a", "calls", k) for k in range(1, 13)], R)
    parts = context.sections(e, r)
    made = {x.id: x for x in context.synthesize(parts, "debug", 300).collect()}
    a = made["a"]
    assert a.included.startswith("source_code,callers") and "- ... and 2 more" in a.text and a.tokens < 300 and "# ... (truncated)" in a.text
    assert made["c01"].included == "callees" and 0 < made["c01"].sufficiency < 0.3
    fixed = {x.id: x for x in context.synthesize_fixed(parts, 400).collect()}
    assert fixed["a"].included.startswith("docstring,signature,source_code") and fixed["a"].truncated
    assert fixed["c01"].included == "callees" and not fixed["c01"].truncated
    small = {x.id: x for x in context.synthesize_fixed(parts, 140).collect()}["a"]
    assert "source_code" not in small.included and small.truncated
    assert context.search_summary(e.filter("id = 'a'"), "a").first().text.startswith("# Search Results for 'a'\n\n## Function: `m.a`")
    assert context.search_summary(e.filter("id = 'none'"), "zz").first().text == "No entities found matching 'zz'"


def test_fold_skips_large_and_keeps_later_small(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([([("a", "", 5), ("big", "", 90), ("b", "", 4)],)], "s array<struct<name:string,text:string,tokens:long>>")
    f = rows.select(context.fold(F.col("s"), 10).alias("f")).first().f
    assert (f.used, f.kept, f.skipped) == (9, ["a", "b"], True)


def test_changelog_entry_and_local_answer(spark):
    from pyspark.sql import functions as F

    from graphloom.operators import answer

    lines = spark.createDataFrame([("a1|Ann|d|feat(core): joins",), ("b2|Bob|d|fix: rank",), ("c3|Ann|d|tidy",)], "value string")
    text = answer.changelog_entry(history.parse_commits(lines), "v1..HEAD", "2024-01-31").first().markdown
    assert "**Focus:** Bug Fixes" in text and "* **core:** joins (`a1`)" in text and text.index("🚀 Features") < text.index("🐛 Fixes") < text.index("Other Changes") and "medium" in text
    assert answer.changelog_entry(history.parse_commits(lines.limit(0)), "x", "y").count() == 0
    row = spark.range(1).select(answer.local_answer(F.lit("locate"), F.lit("ctx")).alias("a"), answer.prompt(F.lit("nope")).alias("p")).first()
    assert row.a == "**Found in codebase:**\n\nctx" and row.p == answer.PROMPTS["general"]
