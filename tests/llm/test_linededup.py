import functools
import random
import re
from collections import Counter

import numpy as np
from graphloom.llm import linededup as L


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(q[-1] + 1, p[j] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_edit_distance():
    r = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(12))) for _ in range(2))
        assert L.edit_distance(a, b) == distance(a, b)


def plain(line):
    return " ".join(re.findall(r"\w+", re.sub(r"\d", "0", line.lower())))


@functools.cache
def letters(a):
    return Counter(a)


def near(a, b):
    """Edit similarity of at least 0.9; the distance is held against a plain one above, no key or SimHash plays a part."""
    most = max(len(a), len(b))
    if 10 * abs(len(a) - len(b)) > most:
        return False
    if sum((letters(a) - letters(b)).values()) > 0.1 * most:  # each edit takes away one letter at most
        return False
    return 10 * L.edit_distance(a, b) <= most


def brute(rows):
    """Texts after dropping, by comparing all pairs of distinct normalised lines by edit similarity alone."""
    places = {}
    for i, t in rows:
        if i is not None:
            for k, line in enumerate((t or "").split("\n")):
                if n := plain(line):
                    places.setdefault(n, set()).add((i, k, t))
    names = sorted(places)
    root = list(range(len(names)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(names)):
        for b in range(a):
            if top(a) != top(b) and near(names[a], names[b]):
                root[top(a)] = top(b)
    first = {}
    for k, n in enumerate(names):
        first[top(k)] = min(first.get(top(k), (1 << 60,)), min(places[n], key=lambda x: x[:2]), key=lambda x: x[:2])
    of = {n: first[top(k)] for k, n in enumerate(names)}
    out = []
    for i, t in rows:
        if i is None or t is None:
            out.append((str(i), t))
            continue
        kept = [x for k, x in enumerate(t.split("\n")) if not (n := plain(x)) or of[n][:2] == (i, k)]
        out.append((str(i), "\n".join(kept)))
    return sorted(out, key=str)


def run(spark, rows):
    names = "doc_id long, text string, n_chars long, node string, n_lines int, text_ string, drops string, text_key int, drop_id_ int, left int"
    df = spark.createDataFrame([(i, t, len(t or ""), "x", 1, "y", "z", 5, 6, 7) for i, t in rows], names).repartition(3)
    got = L.deduplicate(df).collect()
    assert all((r.text is None and r.n_chars is None) or r.n_chars == len(r.text) for r in got)
    assert all((r.node, r.text_, r.drops, r.text_key, r.drop_id_, r.left) == ("x", "y", "z", 5, 6, 7) for r in got)
    assert sorted(((str(r.doc_id), r.text) for r in got), key=str) == brute(rows)
    return got


def test_against_brute_force(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    long = [r.choice(words) for _ in range(40)]

    def variant():
        w = list(long)
        w[r.randrange(40)] = r.choice(words)
        return " ".join(w)

    rows = [(i, "\n".join(variant() if r.random() < 0.4 else " ".join(r.choice(words) for _ in range(r.randrange(1, 12))) for _ in range(4))) for i in range(60)]
    rows += [(5, rows[5][1]), (70, rows[3][1]), (71, None), (72, ""), (73, "\n\n--\n"), (None, rows[0][1]), (74, "Same, LINE 12!\nsame line 98\n\nother"), (75, "z " * 40000), (76, "z " * 40000 + "y")]
    got = run(spark, rows)
    assert sum(x.n_dropped for x in got) > 30


def test_one_id_with_two_texts(spark):
    got = L.deduplicate(spark.createDataFrame([(1, "a b c\nunique words here"), (1, "quite another\na b c"), (0, "a b c")], "doc_id long, text string")).collect()
    assert sorted(r.text for r in got) == ["a b c", "quite another", "unique words here"]


def test_empty(spark):
    assert L.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def lines_of_table(sf):
    import pyarrow.parquet as pq

    text = pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"])["text"].to_pylist()
    return sorted({n for x in text for line in (x or "").split("\n") if (n := plain(line))})


def met(x, y):
    lines = L.Lines(L.cleaned(x + "\n" + y))
    rows, keys, value = L.block_keys(lines, np.arange(2))
    return bool(set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())) and bool(L.near(value[:1], value[1:])[0])


def test_recall_on_all_pairs_of_a_table():
    names = lines_of_table("sf0.001")
    links = [met(a, b) for k, a in enumerate(names) for b in names[:k] if near(a, b)]
    print(len(links), sum(links))
    assert len(links) > 20 and sum(links) >= 0.95 * len(links)


def edited(kind, n, want):
    """Pairs (line of n words, edited line) of edit similarity 0.9 or more."""
    r = random.Random(f"{kind}{n}")
    names = lines_of_table("sf0.01")
    words = sorted({w for x in names for w in x.split()})
    pool = [x.split() for x in names if len(x.split()) >= n]
    out = []
    while len(out) < want:
        w = r.choice(pool)
        s = r.randrange(len(w) - n + 1)
        w = w[s : s + n]
        v = list(w)
        if kind == "word":
            v[r.randrange(n)] = r.choice(words)
        elif kind == "words":
            for _ in range(max(2, n // 20)):
                v[r.randrange(n)] = r.choice(words)
        elif kind == "insert":
            v.insert(r.randrange(n), r.choice(words))
        x, y = " ".join(w), " ".join(v)
        if kind == "letter":
            k = r.randrange(len(y))
            y = " ".join((y[:k] + r.choice("abcdefg") + y[k + 1 :]).split())
        if x != y and 10 * L.edit_distance(x, y) <= max(len(x), len(y)):
            out.append((x, y))
    return out


def test_recall_by_length_and_kind_of_edit():
    found = {(kind, n): sum(met(x, y) for x, y in edited(kind, n, 100)) for kind in ("word", "letter", "insert", "words") for n in (8, 12, 20, 40, 80)}
    print(found)
    assert all(v >= 90 for v in found.values())


def test_short_lines_lose_no_pair():
    r = random.Random(9)
    for _ in range(3000):
        a = "".join(r.choice("abcd ") for _ in range(r.randrange(9, L.SHORT + 1)))
        b = list(a)
        for _ in range(r.randrange(1, 3)):
            k = r.randrange(len(b))
            b[k : k + r.randrange(2)] = r.choice(["", "e", "f"])
        b = "".join(b)
        if len(b) <= L.SHORT and a != b and L.alike(a, b):
            assert L.pieces(a) & L.pieces(b)


def test_fast_acceptance_agrees_with_the_distance():
    for kind in ("word", "words", "insert"):
        for x, y in edited(kind, 12, 60):
            assert L.alike(x, y)
            far = y + " " + x[: len(x) // 8]
            assert L.alike(x, far) == (10 * distance(x, far) <= max(len(x), len(far)))


def test_counts_of_pairs_bound_the_distance():
    r = random.Random(21)
    for _ in range(500):
        a, b = ("".join(r.choice("abcdeé ") for _ in range(r.randrange(30))) for _ in range(2))
        x, y = L.pair_counts([a, b])
        assert abs(x - y).sum() <= 4 * distance(a, b)


def test_common_subsequence():
    r = random.Random(22)
    for _ in range(500):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(12))) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert L.common(a, b) == best[-1][-1]
        assert (len(a) + len(b)) / 2 - L.common(a, b) <= distance(a, b)


def test_crowd_of_half_similar_lines(spark, monkeypatch):
    """More lines of one bucket than a block holds, unlike each other but for some pairs."""
    monkeypatch.setattr(L, "BLOCK", 32)
    r = random.Random(8)
    shared = [f"common{i}" for i in range(9)]
    rows = []
    for i in range(120):
        w = shared + ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(11)]
        rows.append((i, " ".join(w)))
        if i % 10 == 0:
            w[12] = "other"
            rows.append((1000 + i, " ".join(w)))
    run(spark, rows)


def test_lines_with_one_word_changed_go(spark):
    pairs = edited("word", 8, 60) + edited("word", 30, 60) + edited("letter", 15, 60)
    rows = [(2 * k + i, p[i]) for k, p in enumerate(pairs) for i in (0, 1)]
    got = L.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    gone = {r.doc_id for r in got if r.n_dropped}
    assert sum(2 * k + 1 in gone for k in range(len(pairs))) >= 0.97 * len(pairs)
