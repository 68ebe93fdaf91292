import re
import zlib

import corpus_pipeline as C
from graphloom.llm import linededup, neardup, quality, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_act_on_what_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    left = docs
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, left, SF).cache()
        assert out.columns == docs.columns
        before, after = {r.doc_id: r for r in left.collect()}, {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if name == "line dedup":
            want = {r.doc_id: r for r in linededup.deduplicate(left).collect()}
            emptied = {i for i, r in want.items() if r.n_dropped and not re.search(r"\w", r.text)}
            assert emptied and {i: r.text for i, r in after.items()} == {i: r.text for i, r in want.items() if i not in emptied}
        elif name == "MinHash near-dedup":
            want = {r.doc_id for r in neardup.near_duplicates(left).collect() if r.kept}
            assert set(after) == want
        else:
            scored = (quality if name == "quality classifier" else toxicity).classify(left, spark.read.parquet(f"{SF}/labels.parquet"))
            good = 1 if name == "quality classifier" else 0
            assert set(after) == {r.doc_id for r in scored.collect() if r.predicted == good}
            assert all(after[i] == before[i] for i in after)
        left = out
    pieces = C.packing_stage(spark, left, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in left.select("doc_id").collect()}


def test_documents_emptied_by_the_line_stage_go(spark):
    rows = [(1, "one line of words here\nand another one"), (2, "One line of words, here!"), (3, "одна строка слов\nand another one"), (4, "--\n"), (5, None), (6, ""), (None, "and another one")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in C.line_stage(spark, docs, SF).collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 3: ("одна строка слов", 16), 4: ("--\n", 3), 5: (None, None), 6: ("", 0), None: ("and another one", 15)}


def test_run_and_empty_tables(spark, tmp_path):
    assert C.run(spark, SF).count() > 50
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs, spark.read.parquet(f"{sf}/labels.parquet")


def test_held_out_accuracy(spark):
    docs, labels = rows(spark, "/root/testdata/sf0.1")
    for module, target, fold, modulus, least in ((quality, "quality", 1, 3, 0.98), (toxicity, "toxic", 0, 5, 0.96)):
        got = {r.doc_id: r for r in module.classify(docs.join(labels, "doc_id").select(docs["*"]), labels).collect()}
        right = total = 0
        for r in labels.collect():
            held = zlib.crc32(str(r.doc_id).encode()) % modulus == fold
            assert got[r.doc_id].held_out == held
            if held:
                total += 1
                right += got[r.doc_id].predicted == r[target]
        assert right >= least * total


def test_odd_rows_and_missing_labels(spark):
    odd = spark.createDataFrame([(1, None, 7), (2, "", 7), (None, "a b", 7), (3, "x" * 300000, 7), (3, "x" * 300000, 7), (4, "you\n\n idiot", 7)], "doc_id long, text string, score int")
    for module, target in ((quality, "quality"), (toxicity, "toxic")):
        none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
        one = spark.createDataFrame([(i, 1, 1) for i in range(10)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
        for labels in (none, one):
            got = module.classify(odd, labels).collect()
            assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        assert module.classify(odd.limit(0), one).count() == 0


def test_offending_offsets():
    import numpy as np

    text = "fine\nyou  bad worse ok"
    assert toxicity.spans(text, np.array([0.1, 0.2, 0.9, 0.8, 0.1])) == [(10, 19, 0.9)]


def test_forward_backward_equals_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    x, trans, counts = rng.standard_normal(9), rng.standard_normal((2, 2)), np.array([4, 1, 4])
    got, pairs = toxicity.forward_backward(x, counts, trans, pairs=True)
    at, want, expected = 0, [], np.zeros((2, 2))
    for n in counts:
        p, e, z = np.zeros(n), np.zeros((2, 2)), 0.0
        for s in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(x[at + k] * s[k] for k in range(n)) + sum(trans[s[k], s[k + 1]] for k in range(n - 1)))
            z += w
            p += w * np.array(s)
            for k in range(n - 1):
                e[s[k], s[k + 1]] += w
        want += list(p / z)
        expected += e / z
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, expected)
