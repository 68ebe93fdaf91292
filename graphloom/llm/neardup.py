"""Near-duplicate documents by MinHash, banding and connected components.

1. Every document becomes the set of its 5-word shingles (64-bit hashes); 128 universal
   hash minima are its signature. Documents with equal sets are one class, represented
   by the smallest id, from here on.
2. Bands of the signature are bucket keys; buckets of one document are dropped at once.
   Each document is confirmed against the one smallest-id bucket partner it shares most
   bands with, on full shingle sets made anew from the texts of the documents concerned.
   Alternating large-star and small-star gives the components of these links.
3. Buckets whose members are then in more than one component are compared by signature,
   in blocks of bounded size. A pair in different components is a candidate where the
   estimated similarity is at least ``FLOOR`` and the sizes allow 0.75. Of each block only
   as many candidates leave as connect the documents concerned; they form groups, in
   which the full sets, read once for each document, are compared block by block. Links
   are all that leaves a block, never pairs, so neither a group of copies nor a crowd of
   half-similar documents multiplies rows, and no link between components is lost.

With 32 bands of 4 minima a pair at the limit of 0.75 shares no band with probability
5e-6; its estimate falls below FLOOR = 0.6 with probability 4e-5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, group_runs, saved, shared_keys, small_batches, tiles

WORDS = 5
PERCENT = 75  # link where 100 * intersection >= PERCENT * union
MINIMA, BANDS = 128, 32
FLOOR = 0.6
BLOCK = 1024
CACHE_WORDS = 500_000

_RNG = np.random.default_rng(20240131)
_A = _RNG.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, MINIMA, dtype=np.uint64)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word (bytes) to 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= 100:
            self[word] = found
        return found


_WORDS = _Words()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text.

    ``bytes.lower`` and ``bytes.split`` act on A-Z and on the blanks 0x20, 0x09-0x0D alone,
    which is the definition of words here. A text of fewer words is one shingle; one
    without words has none.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, tokens), np.uint64, len(tokens))
    n = min(words, len(tokens))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = out * _MULTIPLIER + h[k : len(h) - n + 1 + k]
            out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    """The minima of MINIMA multiply-shift hashes (32 bits each) of a set."""
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 1024):
            block = (found[at : at + 1024, None] * _A + _B) >> np.uint64(32)
            np.minimum(out, block.min(0).astype(np.uint32), out=out)
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the similarity, compared without division."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (small + large - both)


def unpacked(raw: pa.Scalar) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), np.uint64)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit hash of the set, null if empty) and sig of every row."""
    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text)
                n.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sigs.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_key", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary")


def _sets_of(docs: DataFrame, ids: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, shingles binary) of the documents in ``ids(id)``, made from their texts."""
    small_batches(docs)
    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            made = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "set_key", "words"])

    made = wanted.mapInArrow(run, "id long, set_key binary, words binary")
    return made.join(keys, ["id", "set_key"], "left_semi").dropDuplicates(["id", "set_key"])


def confirm(pairs: DataFrame, docs: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of representatives whose full shingle sets reach the similarity."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = saved(_sets_of(docs, ids, reps.select("id", "set_key")).select("id", "words"), "sets")
    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").select("a", "b", "wa", "wb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wa, wb = batch.column(2), batch.column(3)
            keep = [similar(unpacked(x), unpacked(y), percent) for x, y in zip(wa, wb, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    out = saved(both.mapInArrow(run, "a long, b long"), "links")
    discard(sets)
    return out


TILE = ("key", "ta", "tb")


def _in_tiles(rows: DataFrame, run, schema: str) -> DataFrame:
    return rows.repartition(*TILE).sortWithinPartitions(*TILE, "id").mapInArrow(run, schema)


def _close_pairs(lo: int, hi: int, columns: dict[str, np.ndarray], sigs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of one tile: row i and the rows in other components that may be similar, likeliest first."""
    mine, root, n = columns["mine"], columns["root"], columns["n"]
    ta, tb = columns["ta"][lo], columns["tb"][lo]
    first, second = np.where(mine[lo:hi] == ta)[0] + lo, np.where(mine[lo:hi] == tb)[0] + lo
    for i in first:
        others = second[second > i] if ta == tb else second
        others = others[(root[others] != root[i]) & (100 * np.minimum(n[others], n[i]) >= PERCENT * np.maximum(n[others], n[i]))]
        if len(others):
            est = (sigs[others] == sigs[i]).mean(1)
            keep = est >= FLOOR
            if keep.any():
                yield i, others[keep][np.argsort(-est[keep], kind="stable")]


def _columns(table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
    columns = {c: table[c].to_numpy() for c in ("id", "root", "n", "mine", "ta", "tb")}
    return columns, np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(-1, MINIMA)


class _Joined(dict):
    """Union of numbers."""

    def top(self, r: int) -> int:
        while r in self:
            r = self[r]
        return r

    def join(self, p: int, q: int) -> bool:
        """Whether they were apart."""
        p, q = self.top(p), self.top(q)
        if p != q:
            self[p] = q
        return p != q


def _candidates(members: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the documents of ``rows(id, root, n, sig)`` with candidates in other components."""
    at = members.select("key", "id").join(rows.select("id", "root"), "id")
    several = at.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    tiled = tiles(at.select("key", "id").join(several, "key", "left_semi"), "key", "id", BLOCK).join(rows, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in group_runs(batches, TILE):
            columns, sigs = _columns(table)
            ids, a, b = columns["id"], [], []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                joined = _Joined()
                for i, others in _close_pairs(lo, hi, columns, sigs):
                    for j in others:
                        if joined.join(int(i), int(j)):
                            a.append(int(ids[i]))
                            b.append(int(ids[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return saved(_in_tiles(tiled.select(*TILE, "mine", "id", "root", "n", "sig"), run, "a long, b long"), "candidates")


def _between(groups: DataFrame, rows: DataFrame, docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, found by comparing full sets within groups (node, root); those that join nothing new in a tile are left out."""
    at = groups.select(F.col("node").alias("id"), F.col("root").alias("key"))
    sets = saved(_sets_of(docs, at.select("id"), reps.select("id", "set_key")).select("id", "words"), "sets")
    tiled = tiles(at, "key", "id", BLOCK).join(rows, "id").join(sets, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in group_runs(batches, TILE):
            columns, sigs = _columns(table)
            words, ids, root, a, b = table["words"], columns["id"], columns["root"], [], []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                joined = _Joined()
                for i, others in _close_pairs(lo, hi, columns, sigs):
                    own = unpacked(words[int(i)])
                    for j in others:
                        p, q = int(root[i]), int(root[j])
                        if joined.top(p) != joined.top(q) and similar(own, unpacked(words[int(j)]), percent):
                            joined.join(p, q)
                            a.append(int(ids[i]))
                            b.append(int(ids[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    small_batches(docs)
    out = saved(_in_tiles(tiled.select(*TILE, "mine", "id", "root", "n", "sig", "words"), run, "a long, b long"), "links")
    discard(sets)
    return out


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Needs ``doc_id`` and ``text``; other columns are left out. Null and empty texts link
    with nothing. A null doc_id is never linked: its component_id is null and it is kept.
    Rows that repeat a doc_id are one document for linking and each get a row. Ties fall
    to the smallest id. An empty table gives no rows.
    """
    rows = saved(sketch(docs), "sketch")
    known = rows.filter("n_shingles > 0 and doc_id is not null")
    reps = saved(known.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")), "reps")
    band = 4 * MINIMA // BANDS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(F.expr("sig").substr(k * band + 1, F.lit(band)), k))
    # an id that repeats with other texts stands for several sets: those are linked as one node
    keyed = reps.select(F.explode(keys).alias("key"), F.col("id").alias("node"))
    members = saved(shared_keys(keyed).select("key", F.col("node").alias("id"), "a"), "buckets")
    shared = members.filter("a < id").groupBy("a", "id").agg(F.count("*").alias("n"))
    first = saved(shared.groupBy(F.col("id").alias("b")).agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b"), "pairs")

    copies = known.join(reps.select("set_key", F.col("id").alias("rep")), "set_key").filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = confirm(first, docs, reps, percent)
    discard(first)
    comps = components(links)
    shared = members.select("id").distinct()
    open_rows = saved(reps.join(shared, "id", "left_semi").join(comps.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"), "n", "sig"), "rows")
    candidates = _candidates(members, open_rows)
    discard(members)
    if not candidates.isEmpty():
        links = links.union(_between(components(candidates), open_rows, docs, reps, percent))
    discard(open_rows)
    discard(candidates)
    whole = components(links.union(copies))
    out = rows.select("doc_id", "n_shingles").join(whole.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"), F.coalesce(F.coalesce("root", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
