"""Byte-level BPE encoding and decoding with a local vocabulary file.

``ChunkEncoder`` cuts a text at safe boundaries: a single line feed between two
non-space characters, and a single space between two non-space characters. No match of
the pre-splitting pattern crosses such a place (the space begins the next match, the
line feed is a match of its own), so chunks are encoded one by one and the ids joined.
Distinct chunks are encoded once and kept in a bounded cache. Where a piece is empty or
begins or ends with white space (runs of blanks), its neighbours are joined to it until
the boundaries are safe again, so memory per encoder call stays bounded by the text.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_without_columns, small_batches

CACHE_CHUNKS = 700_000


def ranks_from_tiktoken(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def ranks_from_tokenizer_json(path: str) -> dict[bytes, int]:
    """The ranks in a ``tokenizers`` file of a byte-level BPE model, special tokens left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a ``tokenizers`` file, which the library finds in a text before all else.

    Only tokens that match as they stand are known here; others raise an error.
    """
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if odd := [t["content"] for t in added if t["lstrip"] or t["rstrip"] or t["single_word"]]:
        raise ValueError(f"added tokens that take in blanks or whole words only are not supported: {odd}")
    return {t["content"]: t["id"] for t in added}


class ChunkEncoder(dict):
    """Text to ids, as little-endian unsigned 32-bit bytes. The dict maps chunks to their ids.

    ``added`` tokens become their own ids wherever they stand in a text, and the text
    between them is encoded by itself; without them every text is plain.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, added: dict[str, int] | None = None):
        super().__init__()
        self.added = {text: np.array([i], "<u4").tobytes() for text, i in (added or {}).items()}
        self.cuts = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.feed = self._raw("\n")

    def _raw(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes | None:
        if not word or word[0].isspace() or word[-1].isspace():
            return None  # not a safe boundary; join() fails and the caller takes the careful way
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        out = self._raw(" " + word)
        if len(word) <= 200:
            self[word] = out
        return out

    def _line(self, line: str) -> bytes:
        if not line or line[0].isspace() or line[-1].isspace():
            raise TypeError("unsafe boundary")
        first, *rest = line.split(" ")
        if not first or first[-1].isspace():
            raise TypeError("unsafe boundary")
        return self._raw(first) + b"".join(map(self.__getitem__, rest))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cuts is None or not self.cuts.search(text):
            return self._plain(text)
        out, at = [], 0
        for found in self.cuts.finditer(text):
            out += [self._plain(text[at : found.start()]), self.added[found[0]]]
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        out = []
        held: list[str] = []  # lines that must be encoded together
        for line in text.split("\n"):
            safe = bool(line) and not line[0].isspace() and not line[-1].isspace()
            if held and safe and held[-1] and not held[-1][-1].isspace():
                out.append(self._held(held))
                held = []
            held.append(line)
        out.append(self._held(held))
        return self.feed.join(out)

    def _held(self, lines: list[str]) -> bytes:
        if len(lines) == 1:
            try:
                return self._line(lines[0])
            except TypeError:
                pass
        return b"".join(map(self._raw, safe_chunks("\n".join(lines))))


def safe_chunks(text: str, least: int = 4096) -> Iterator[str]:
    """Pieces of at least ``least`` characters, cut before single spaces between non-space characters."""
    start, n = 0, len(text)
    while start < n:
        at = start + least
        while True:
            at = text.find(" ", at)
            if at < 0 or at + 1 >= n:
                at = n
                break
            if not text[at - 1].isspace() and not text[at + 1].isspace():
                break
            at += 1
        yield text[start:at]
        start = at


_ENCODERS: dict = {}


def encoder(path: str, pattern: str) -> ChunkEncoder:
    """One encoder for each vocabulary file and worker process."""
    if (path, pattern) not in _ENCODERS:
        if path.endswith(".json"):
            made = ChunkEncoder(ranks_from_tokenizer_json(path), pattern, added_tokens(path))
        else:
            made = ChunkEncoder(ranks_from_tiktoken(path), pattern)
        _ENCODERS[path, pattern] = made
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and ``ids array<int>`` of every whole text; a null text counts as empty (no ids).

    Repeated rows, null keys and empty tables pass through; other columns are left out.
    """
    small_batches(docs)
    fields = [f for f in docs.schema if f.name in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            parts = [enc.encode(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            flat = np.frombuffer(b"".join(parts), dtype="<i4")
            ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*batch.schema.names[:-1], "ids"])

    return rows_without_columns(docs, [*(f.name for f in fields), text]).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``decoded binary``: the raw bytes of the ids, which need not be valid UTF-8 where ids are cut."""
    fields = encoded.schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", decoded binary"
    at = fields.fieldNames().index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern).encoding
        for batch in batches:
            ids = batch.column(at)
            whole, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            out = [enc.decode_bytes(whole[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, type=pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` from encode() and decode()."""
    both = decode(encode(docs, path, pattern), path, pattern)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
