import random

import numpy as np
import pyarrow as pa
from graphloom.llm import linededup as L
from graphloom.llm.edits import Coded, within


def changed(r, line, edits, letters):
    out = list(line)
    for _ in range(edits):
        k = r.randrange(len(out) + 1)
        out[k : k + r.randrange(2)] = r.choice(["", *letters])
    return "".join(out)


def test_many_pairs_at_once_agree_with_the_distance():
    """Bands of one to four words, runs of one letter (carries from word to word), characters beyond a byte."""
    r = random.Random(31)
    lines, allowed = ["", "a", "", ""], [1, 0]
    for letters, longest in (("a", 300), ("ab", 700), ("abcdefgh é", 2500), ("aπ語😀", 60), (list(map(chr, range(0x4E00, 0x4F80))), 400)):
        for _ in range(60):
            x = "".join(r.choice(letters) for _ in range(r.randrange(longest)))
            most = r.choice([0, 1, 5, 63, 64, 100, 130, 200, 255])
            lines += [x, changed(r, x, r.randrange(2 * most + 2), letters)][:: r.choice([1, -1])]
            allowed.append(most)
    x, y = np.arange(0, len(lines), 2), np.arange(1, len(lines), 2)
    got = within(Coded(lines), x, y, np.array(allowed))
    want = [L.edit_distance(lines[i], lines[j]) <= k for i, j, k in zip(x, y, allowed, strict=True)]
    assert got.tolist() == want and 50 < sum(want) < len(want) - 50


def test_pairs_of_any_length_agree_with_one_at_a_time():
    r = random.Random(32)
    lines = []
    for n in (1, 9, 10, 29, 80, 640, 2559, 2560, 6000):
        for share in (12, 10, 8):
            x = "".join(r.choice("abcdefgh ") for _ in range(n))
            lines += [x, changed(r, x, n // share, "abcdefgh ")]
    x, y = np.arange(0, len(lines), 2), np.arange(1, len(lines), 2)
    want = [L.alike(lines[i], lines[j]) for i, j in zip(x, y, strict=True)]
    assert L.alike_pairs(lines, Coded(lines), x, y).tolist() == want and 0 < sum(want) < len(want)


def test_open_pairs_of_tiles(monkeypatch):
    monkeypatch.setattr(L, "AT_ONCE", 50)
    r = np.random.default_rng(33)
    starts = np.array([0, 1, 3, 40, 120])
    n = np.diff(starts)
    columns = {"ta": np.repeat([0, 0, 1, 0], n), "tb": np.repeat([0, 1, 1, 2], n), "root": r.integers(0, 9, 120), "sim": r.integers(20, 30, 120) << 33 | r.integers(0, 1 << 32, 120)}
    columns["mine"] = np.where(r.random(120) < 0.5, columns["ta"], columns["tb"])
    got = [(min(i, j), max(i, j)) for x, y in L._open_pairs(columns, starts) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
    c = columns
    want = [(i, j) for lo, hi in zip(starts[:-1], starts[1:], strict=True) for i in range(lo, hi) for j in range(i + 1, hi) if c["root"][i] != c["root"][j] and (c["ta"][i] == c["tb"][i] or c["mine"][i] != c["mine"][j]) and L.near(c["sim"][i : i + 1], c["sim"][j : j + 1])[0]]
    assert sorted(got) == want and len(want) > 100


def test_tables_of_groups_as_one(monkeypatch):
    monkeypatch.setattr(L, "HELD", 100)
    tables = [(pa.table({"x": list(range(k, k + 4))}), np.array([0, 1, 4])) for k in range(0, 20, 4)]
    got = list(L._large(iter(tables)))
    assert 1 < len(got) < 5 and [x for t, _ in got for x in t["x"].to_pylist()] == list(range(20))
    assert [t["x"][s].as_py() for t, at in got for s in at[:-1].tolist()] == [k + d for k in range(0, 20, 4) for d in (0, 1)]
    assert all(at[-1] == t.num_rows for t, at in got)


def test_contracted_edges_have_the_same_components(spark, monkeypatch):
    r = random.Random(34)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(7, 7)]
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for at_a_time in (250_000, 60):
        monkeypatch.setattr(L, "EDGES_A_TASK", at_a_time)
        got = {x.node: x.root for x in L.components(L._contracted(df)).collect()}
        assert all(got.get(n, n) == m for n, m in root.items())
