import random
import re

from graphloom.llm import neardup as N


def words_of(text):
    """The shingles of the definition, as tuples of words, with no part of the operator."""
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: bytes([m[0][0] + 32]), (text or "").encode()))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=75):
    sets = [(i, words_of(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                p, q = sorted((top(i), top(j)))
                root[q] = p
    return sorted(((str(i), len(s), None if i is None else top(i)) for i, s in sets), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, sig string, n int").repartition(3)
    got = N.near_duplicates(df).collect()
    assert sorted(((str(r.doc_id), r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_shingles_definition():
    assert len(N.shingles("a b c d e")) == len(N.shingles("a b")) == len(N.shingles("a")) == 1
    assert len(N.shingles("A B c d e f")) == 2
    assert (N.shingles("A\tb\x0bc d e") == N.shingles("a b  c\nd e")).all()
    assert (N.shingles("Ä b c d e") != N.shingles("ä b c d e")).all()  # only A-Z are lowered
    assert len(N.shingles("a b c")) == 1 and len(N.shingles(None)) == len(N.shingles(" \n")) == 0
    assert len(N.shingles("x " * 100)) == 1


def test_chains_of_links_and_odd_rows(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    base = [r.choice(words) for _ in range(120)]
    rows, now = [], list(base)
    for i in range(100):  # neighbours are alike, the ends are not
        now[r.randrange(120)] = r.choice(words)
        rows.append((1000 - i, " ".join(now)))
    for i in range(60):  # copies with some words changed, not all alike
        w = list(base)
        for _ in range(r.randrange(1, 5)):
            w[r.randrange(120)] = r.choice(words)
        rows.append((2000 + i, " ".join(w)))
    rows += [(i, " ".join(r.choice(words) for _ in range(50))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " \n"), (53, "short text"), (54, "SHORT  text"), (55, "short texts"), (None, "short text"), (53, "short text"), (56, "z " * 200000), (57, "Z\n" * 150000)]
    run(spark, rows)


def test_table_and_empty(spark):
    run(spark, [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_groups_larger_than_a_block(spark, monkeypatch):
    """Half-similar documents of one bucket, some of them linked, in blocks of few rows."""
    monkeypatch.setattr(N, "BLOCK", 16)
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base, rows = [r.choice(words) for _ in range(100)], []
    for i in range(150):
        rows.append((i, " ".join(base[: r.randrange(70, 96)] + [r.choice(words) for _ in range(r.randrange(4, 22))])))
    run(spark, rows)
