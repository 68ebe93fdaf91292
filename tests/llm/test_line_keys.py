import numpy as np
from graphloom.llm import linededup as L


def test_keys_end_where_one_line_has_them(spark):
    """Keys are dealt as bytes, many to a row; what comes back is held against plain groups."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(2, "doc_id")
    met = L._met(docs).collect()
    keys = np.concatenate([np.frombuffer(r.packed, np.int64).reshape(-1, 3) for r in met if r.kind == L._KEY])
    assert len(met) < len(keys) / 3
    groups, found = {}, {}
    for key, node, sim in keys.tolist():
        groups.setdefault(key, {})[node] = sim
    for r in L.occurrences(docs).collect():
        found.setdefault(r.kind, []).append(r[1:])
    want = sorted((key, node, sim, min(nodes), nodes[min(nodes)], 0) for key, nodes in groups.items() if len(nodes) > 1 for node, sim in nodes.items())
    assert len(want) > 1000 and sorted(found[L._KEY]) == want
    places = {}
    for doc, text, line, node, second, _ in found[L._LINE]:
        places.setdefault((node, second), []).append((doc, line, text))
    assert sorted(found[L._NODE]) == sorted((*k, *min(v), len(v)) for k, v in places.items())
    assert len(found[L._LINE]) == sum(bool(L.normalised(x)) for r in docs.collect() for x in (r.text or "").split("\n"))


def test_texts_of_places(spark):
    docs = spark.createDataFrame([(1, "A b\n\nc 1"), (1, "other"), (1, "A b\n\nc 1"), (2, None), (3, "x")], "doc_id long, text string")
    keyed = L._keyed(docs).filter("text is not null").distinct().collect()
    places = [(10 * r.doc_id + k, r.doc_id, r.text_key, k) for r in keyed for k, x in enumerate(r.text.split("\n")) if x and r.doc_id < 3]
    got = L._texts(docs, spark.createDataFrame(places, "node long, doc_id long, text_key long, line_no int")).collect()
    assert sorted(map(tuple, got)) == [(10, "a b"), (10, "other"), (12, "c 0")]
