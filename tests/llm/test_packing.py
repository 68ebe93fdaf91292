import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from graphloom.llm import packing

PATH = P.path("byte_bpe_50k.json")


def test_cut():
    assert packing.cut(1) == [(0, 1)]
    assert packing.cut(1024) == [(0, 1024)]
    assert packing.cut(1025) == [(0, 1), (1, 1024)]
    assert packing.cut(2048) == [(0, 1024), (1024, 1024)]


def test_best_fit_is_close_to_the_bound():
    sizes = np.random.default_rng(0).integers(1, 1025, 4000)
    which, base, free = packing.best_fit(sizes)
    used = np.bincount(which, weights=sizes)
    assert (used <= 1024).all() and (1024 - used == free).all()
    assert len(free) <= 1.02 * sizes.sum() / 1024 + 5


def check(rows, docs, tok):
    ids = [(d, tok.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in docs]
    want = sorted((str(d), k, s, n, zlib.crc32(np.array(x[s : s + n], "<u4").tobytes())) for d, x in ids for k, (s, n) in enumerate(packing.cut(len(x))))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 1024
    return len(by), sum(len(x) for _, x in ids)


def test_pack_small_and_odd(spark):
    tok = Tokenizer.from_file(PATH)
    docs = [(1, "a b c"), (1, "a b c"), (None, None), (2, ""), (3, "word " * 5000), (4, "lorem ipsum " * 170), (5, "<|endoftext|> plain"), (6, "a <|endoftext|><|endoftext|>\n b<|endoftext"), (7, "x <|endoftext|>" * 700)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, total int").repartition(3)
    check(packing.pack(df, PATH, P.PATTERN).collect(), docs, tok)
    assert packing.pack(df.limit(0), PATH, P.PATTERN).count() == 0


def test_pack_table(spark):
    tok = Tokenizer.from_file(PATH)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    bins, tokens = check(packing.pack(df.repartition(5), PATH, P.PATTERN).collect(), docs, tok)
    assert bins <= 1.03 * tokens / 1024 + 1


def test_rounds_that_cannot_merge_end(spark):
    df = spark.createDataFrame([(i, "a b c d e f g h " * 75) for i in range(300)], "doc_id long, text string").repartition(20)
    rows = packing.pack(df, PATH, P.PATTERN).collect()
    assert len(rows) == 300 and len({r.sequence_id for r in rows}) == 300
