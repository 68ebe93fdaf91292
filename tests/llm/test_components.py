import random

from graphloom.llm.common import components


def brute(edges):
    root = {}

    def top(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in edges:
        if a != b:
            p, q = sorted((top(a), top(b)))
            root[q] = p
    return sorted((k, top(k)) for k in root)


def check(spark, edges):
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted((r.node, r.root) for r in got.collect()) == brute(edges)


def test_components(spark):
    r = random.Random(6)
    check(spark, [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(k, 200) for k in range(150, 190)] + [(7, 7), (3, 4), (4, 3), (-5, 900)])
    check(spark, [(r.randrange(300), r.randrange(300)) for _ in range(200)])
    check(spark, [(2, 1), (3, 1)])


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_groups_are_whole_whatever_the_batches():
    import numpy as np
    import pyarrow as pa

    from graphloom.llm.common import group_runs

    r = random.Random(3)
    for _ in range(60):
        keys = sorted(r.randrange(6) for _ in range(r.randrange(1, 40)))
        cuts = sorted(r.randrange(len(keys) + 1) for _ in range(r.randrange(5)))
        parts = [keys[a:b] for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True)]
        batches = [pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(range(len(p)), pa.int64())], ["k", "v"]) for p in parts]
        got = []
        for table, at in group_runs(iter(batches), ("k",)):
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                got.append(table["k"].to_pylist()[lo:hi])
            assert at[-1] == table.num_rows
        assert [g[0] for g in got] == sorted(set(keys)) and all(len(set(g)) == 1 for g in got) and sum(map(len, got)) == len(keys)
        assert isinstance(at, np.ndarray)


def test_shared_keys_over_small_batches(spark, monkeypatch):
    from graphloom.llm import common

    monkeypatch.setattr(common, "small_batches", lambda df: df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3"))
    r = random.Random(8)
    rows = [(r.randrange(12), k, k * 10) for k in range(60)] + [(100, 900, 1), (101, 901, 1)] + [(102, 1000 + k, k) for k in range(20)]
    got = sorted((x.key, x.node, x.sim, x.a, x.sa) for x in common.shared_keys(spark.createDataFrame(rows, "key long, node long, sim long"), "sim", "sa").collect())
    by = {}
    for k, n, s in rows:
        by.setdefault(k, []).append((n, s))
    assert got == sorted((k, n, s, *min(v)) for k, v in by.items() if len(v) > 1 for n, s in v)
