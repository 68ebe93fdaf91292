import math

import numpy as np

from graphloom.llm import annforest, embdup

SCHEMA = "vec_id long, embedding array<float>, label int, v string"


def odd_rows():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 8))
    rows = [(i, [float(c) for c in base[i % 12] + 0.25 * rng.standard_normal(8)]) for i in range(150)]
    rows += [(200 + i, [float(c) for c in base[0]]) for i in range(8)]
    rows += [(200, rows[-8][1]), (300, None), (301, [0.0] * 8), (302, [1.0, None] + [0.0] * 6), (303, [math.nan] * 8), (304, [math.inf] + [0.0] * 7), (None, rows[0][1]), (350, [])]
    rows += [(400, [1.0, 2.0]), (401, [1.0, 2.0]), (402, [1.0, 2.0, 3.0]), (450, [1.0] * 9)]
    return [(i, v, 1, "x") for i, v in rows]


def usable(rows):
    return {i: np.array(v, np.float32).astype(float) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v) and len(v) in (8, 64)}


def brute_links(rows, limit=0.95):
    vec = usable(rows)
    ids = sorted(vec)
    x = annforest.unit(np.stack([vec[i] for i in ids])) if ids else np.zeros((0, 1))
    link = x @ x.T >= limit
    root = list(range(len(ids)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in zip(*np.where(link), strict=True):
        p, q = sorted((top(a), top(b)))
        root[q] = p
    out = {i: (int(link[k].sum()) - 1, ids[top(k)]) for k, i in enumerate(ids)}
    return [(str(i), *(out.get(i, (0, i)))) for i, *_ in rows]


def check_links(spark, rows):
    got = embdup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((str(r.vec_id), r.n_links, r.component_id) for r in got), key=str) == sorted(brute_links(rows), key=str)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embdup, "CELL", 20)
    monkeypatch.setattr(embdup, "HOME", 8)
    monkeypatch.setattr(embdup, "GUESTS", 16)
    check_links(spark, odd_rows())


def test_links_planted_in_many_cells(spark, monkeypatch):
    """Chains and stars of links at and around the limit among vectors without structure."""
    monkeypatch.setattr(embdup, "CELL", 200)
    monkeypatch.setattr(embdup, "HOME", 100)
    rng = np.random.default_rng(12)
    x = list(rng.standard_normal((1500, 64)))
    for k in range(400):
        x.append(x[rng.integers(len(x))] + rng.uniform(0.1, 0.4) * rng.standard_normal(64))
    rows = [(int(i), [float(c) for c in np.float32(v)], 1, "x") for i, v in zip(rng.permutation(len(x)), x, strict=True)]
    assert sum(n > 0 for _, n, _ in brute_links(rows)) > 300
    check_links(spark, rows)


def test_links_of_the_table(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    check_links(spark, [(r.vec_id, r.embedding, r.label, "") for r in t])


def test_links_empty(spark):
    assert embdup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    got = embdup.near_duplicates(spark.createDataFrame([(1, None, 1, "")], SCHEMA)).collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in got] == [(1, 0, 1, True)]


def brute_nearest(rows, every=50, top=5):
    vec = usable(rows)
    ids = np.array(sorted(vec))
    x = annforest.unit(np.stack([vec[i] for i in ids]))
    out = {}
    for k in np.where(ids % every == 0)[0]:
        s = x @ x[k]
        s[k] = -np.inf
        near = np.lexsort((ids, -s))[: min(top, len(ids) - 1)]
        out[int(ids[k])] = [(int(ids[j]), float(s[j])) for j in near]
    return out


def test_search_of_odd_rows_is_exact_while_all_is_looked_at(spark):
    rows = odd_rows()
    got = annforest.search(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute_nearest(rows)
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == {(q, k + 1, i) for q, near in want.items() for k, (i, _) in enumerate(near)}
    assert all(abs(r.score - want[r.query_id][r["rank"] - 1][1]) < 1e-12 for r in got)
    assert annforest.search(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_on_the_table(spark):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = annforest.search(t).collect()
    want = brute_nearest([(r.vec_id, r.embedding) for r in t.collect()])
    found = {(r.query_id, r.vec_id) for r in got}
    pairs = {(q, i) for q, near in want.items() for i, _ in near}
    assert len(found & pairs) >= 0.9 * len(pairs)
    assert len(got) == 5 * len(want)


def recall(spark, rows):
    got = annforest.search(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute_nearest(rows)
    assert len(got) == 5 * len(want)
    return got, want


def test_recall_where_a_third_is_one_vector(spark, monkeypatch):
    """The walk looks at SHARE of the entries; the copies take no part of it."""
    monkeypatch.setattr(annforest, "LEAST", 1)
    x = np.random.default_rng(8).standard_normal((9000, 64)).astype(np.float32)
    x[::3] = x[0]
    got, want = recall(spark, [(i, [float(c) for c in v], 1, "x") for i, v in enumerate(x)])
    other = {q for q in want if q % 3}
    pairs = {(q, i) for q in other for i, _ in want[q] if i % 3}
    found = {(r.query_id, r.vec_id) for r in got}
    print(len(found & pairs) / len(pairs))
    assert len(found & pairs) >= 0.9 * len(pairs)
    assert all(abs(r.score - 1) < 1e-12 and r.vec_id <= 15 for r in got if r.query_id % 3 == 0)


def test_recall_of_the_share_alone(spark, monkeypatch):
    """With LEAST out of force, as on larger tables."""
    monkeypatch.setattr(annforest, "LEAST", 1)
    x = np.random.default_rng(9).standard_normal((6000, 64)).astype(np.float32)
    got, want = recall(spark, [(i, [float(c) for c in v], 1, "x") for i, v in enumerate(x)])
    pairs = {(q, i) for q, near in want.items() for i, _ in near}
    share = len({(r.query_id, r.vec_id) for r in got} & pairs) / len(pairs)
    print(share)
    assert share >= 0.9
