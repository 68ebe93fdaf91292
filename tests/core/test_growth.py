"""What must not grow faster than the input: exchanges, repeated rows, memory of a task."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from graphloom import catalog
from graphloom.operators import context, history, retrieval
from graphloom.plans import text_queries, views

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_callers_listing_deals_edges_once_for_the_join_and_once_by_target(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = spark.range(30).selectExpr("concat('e', id) as id", "concat('q', id) as qualified_name", "concat('q', id, '(x)') as signature")
        r = spark.range(24).selectExpr("concat('e', id) as source_id", "case when id % 2 = 0 then 't' end as target_id", "'calls' as kind", "100 - id as ord")
        r = r.union(spark.sql("select 'unknown', 't', 'calls', 0L"))
        made = context.callers_listing(e, r)
        assert plan(made).count("Exchange hashpartitioning") == 3
        found = {x["id"]: x["callers"].split("\n") for x in made.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found["t"][2:4] == ["- `q22` - `q22(...)`", "- `q20` - `q20(...)`"] and found["t"][-1] == "- ... and 2 more"
    assert len(found["t"]) == 13 and len(found[None]) == 13  # an unknown target is a group, as in SQL


def test_modified_by_author_repeats_no_change_and_bounds_its_tasks(spark):
    rows = [(1, "a", 2.0), (1, "a", 3.0), (1, "b", 1.0), (2, "a", 5.0), (2, None, 7.0), (3, "c", 1.0), (9, "z", 4.0)]
    modified = spark.createDataFrame(rows, "commit_id long, entity_id string, insertions double")
    authors = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (3, None), (8, "w")], "commit_id long, author_name string")
    made = history.modified_by_author(modified, authors)
    assert "Expand" not in plan(made) and "REPARTITION_BY_NUM" in plan(made)
    assert {tuple(r) for r in made.collect()} == {("x", 2, 2, 18.0), ("y", 1, 1, 12.0), (None, 1, 1, 1.0)}


def test_overlaps_hold_no_more_than_a_bounded_part_of_a_batch():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    asked = [(q, words[t]) for q in range(200) for t in rng.choice(300, 40, replace=False)]
    texts = [[words[t] for t in rng.choice(300, 40, replace=False)] for _ in range(10_000)] + [None, []]
    batch = pa.record_batch([pa.array([f"c{k}" for k in range(10_002)]), pa.array(np.arange(10_002)[::-1].copy()), pa.array(texts, pa.list_(pa.string()))], ["id", "ord", "tokens"])
    few = pa.table({"qid": [q for q, _ in asked], "token": [t for _, t in asked]})
    tracemalloc.start()
    out = pa.Table.from_batches(list(retrieval.overlaps(iter([batch, batch.slice(0, 0)]), few, few["qid"].unique(), 7)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    of = Counter(t for _, t in asked)
    assert peak < 2 * 8 * sum(of[t] for x in texts for t in x or ())  # two arrays of all hits at once
    found: dict = {}
    for r in out.to_pylist():
        found.setdefault(r["qid"], []).append((-r["overlap"], r["ord"], r["id"]))
    for q in range(0, 200, 20):
        mine = {t for p, t in asked if p == q}
        count = Counter({k: len(mine.intersection(t or ())) for k, t in enumerate(texts)})
        want = sorted((-n, 10_001 - k, f"c{k}") for k, n in count.items() if n)[:7]
        assert sorted(found[q])[:7] == want


def test_vectors_with_nan_come_first_as_in_sql(spark):
    v = spark.createDataFrame([(f"v{k}", [float(k), 1.0], k) for k in range(3000)] + [("bad", [float("nan"), 1.0], 9999)], "id string, embedding array<float>, ord long")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, embedding array<float>")
    assert [r["id"] for r in retrieval.knn(v, q, 3).orderBy("rank").collect()] == ["bad", "v2999", "v2998"]


def test_leaf_entities_deals_keys_not_edges(spark):
    made = catalog.queries()["leaf_entities"](spark, SF)
    for column in ("l_orderkey", "l_partkey", "o_custkey"):  # distinct as numbers, before the ids are made
        assert f"HashAggregate(keys=[{column}" in plan(made)
    r = views.relationships(spark, SF, kinds=("calls", "contains")).select("source_id", "kind").distinct()
    found = views.sources(spark, SF, ("calls", "contains"))
    assert found.distinct().exceptAll(r).isEmpty() and r.exceptAll(found).isEmpty()


def test_token_frequency_deals_tokens_not_pairs(spark):
    assert "[token" in (made := plan(catalog.queries()["token_frequency"](spark, SF))) and "hashpartitioning(token" in made
    assert not any("doc_id" in x for x in made.split("\n") if "Exchange hashpartitioning" in x)
    docs = spark.createDataFrame([(1, "aa aa bb"), (2, "bb"), (2, "bb cc"), (None, "cc dd"), (3, None)], "doc_id long, text string")
    found = {tuple(r) for r in text_queries.frequency(docs, docs.select("doc_id")).collect()}
    assert found == {("aa", 2, 1), ("bb", 3, 2), ("cc", 2, 1), ("dd", 1, 0)}  # n_docs counts distinct ids, so no null
