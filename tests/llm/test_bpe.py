import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from graphloom.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None,
    "",
    " ",
    "a",
    "\n",
    "a\n\nb",
    "a\nb c",
    " lead and trail ",
    "two  spaces\tand\ttabs",
    "it's we'll 'tis 123 4.5!! \n x",
    "héllo wörld ñ nbsp sep \x1c ctl",
    "<|endoftext|> plain",
    "日本語 テキスト 🙂🙂",
    "x" * 5000,
    "word " * 3000,
    "\n \n  \n",
    "a \nb\n c",
]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("r", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_from_tiktoken(PATH), special_tokens={})


def test_chunks_join_to_whole_encoding(reference):
    enc = bpe.encoder(PATH, P.PATTERN)
    for t in TEXTS:
        import numpy as np

        assert np.frombuffer(enc.encode(t), "<u4").tolist() == reference.encode_ordinary(t or "")


def test_json_vocabulary_equals_the_tokenizers_library():
    import numpy as np

    path = P.path("byte_bpe_50k.json")
    enc, tok = bpe.encoder(path, P.PATTERN), Tokenizer.from_file(path)
    for t in [*TEXTS, "<|endoftext|> plain", "a <|endoftext|>\n\n <|endoftext|><|endoftext|>b <|endoftext| >"]:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tok.encode(t or "", add_special_tokens=False).ids


def test_digests(spark, reference):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (3, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.round_trip_digests(df, PATH, P.PATTERN).collect()
    assert len(got) == len(rows)
    want = sorted(
        (str(i), len(ids := reference.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t, _ in rows
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_empty_table(spark):
    assert bpe.round_trip_digests(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0
