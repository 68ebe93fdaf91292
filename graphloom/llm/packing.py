"""Best-fit packing of token sequences by hierarchical residual rounds.

Every partition packs its own pieces best-fit, largest first, and emits nearly full
bins. Underfull bins become items: they are merged in a tree of ever fewer partitions,
each again packed best-fit, until one partition is left or the bins that remain are more
than one task should hold and no longer get fewer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import rows_without_columns, saved, small_batches

CAPACITY = 1024
END_ID = 2
SLACK = 8  # a bin with at most so many free places is nearly full
FAN_IN = 8  # partitions merged into one by a round
TASK_BINS = 100_000  # underfull bins that one task of a round may hold

_MEMBER = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]
_BINS = "full boolean, total int, members array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>>"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole if it fits, else the first piece takes the rest."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and place in it, and each bin's free places.

    Open bins are kept by their free places; a bit mask finds the least free place that
    fits, so an item costs a few operations however many bins are open.
    """
    which, base = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[int] = []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = open_at[left].pop()
            if not open_at[left]:
                mask &= ~(1 << left)
        else:
            left, b = capacity, len(free)
            free.append(capacity)
        which[i], base[i] = b, capacity - left
        left -= size
        free[b] = left
        if left:
            open_at[left].append(b)
            mask |= 1 << left
    return which, base, np.array(free, np.int64)


def _bins(members: pa.StructArray, counts: np.ndarray, sizes: np.ndarray, capacity: int, slack: int) -> pa.RecordBatch:
    """Pack items (``counts`` members each, in order) and return one row per bin."""
    which, base, free = best_fit(sizes, capacity)
    order = np.argsort(which, kind="stable")
    begins = np.concatenate([[0], np.cumsum(counts)])[:-1]
    n = counts[order]
    ends = np.cumsum(n)
    take = np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n) + np.repeat(begins[order], n)
    flat = members.take(pa.array(take))
    columns = [flat.field(name) for name, _ in _MEMBER]
    columns[-1] = pa.array(columns[-1].to_numpy(zero_copy_only=False) + np.repeat(base[order], n))
    per_bin = np.bincount(which, weights=counts, minlength=len(free)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(per_bin)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, [n for n, _ in _MEMBER]))
    return pa.RecordBatch.from_arrays([pa.array(free <= slack), pa.array((capacity - free).astype(np.int32)), lists], ["full", "total", "members"])


def _sliced(batch: pa.RecordBatch, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, slack: int = SLACK) -> DataFrame:
    """Pack all documents into as few sequences of ``capacity`` tokens as the method finds.

    Needs ``doc_id`` and ``text``; other columns are left out. A null or empty text is
    the end id alone. Repeated rows and null ids are packed like any other row. An empty
    table gives no rows. Returns one row per piece: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset, and total (the tokens in the sequence).
    """
    small_batches(docs)
    end = np.array([end_id], "<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, pattern)
        parts: list[list] = [[] for _ in _MEMBER]
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.encode(text) + end
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    for column, value in zip(parts, (doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), 0), strict=True):
                        column.append(value)
        if parts[0]:
            members = pa.StructArray.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(parts, _MEMBER, strict=True)], [n for n, _ in _MEMBER])
            yield from _sliced(_bins(members, np.ones(len(parts[0]), np.int64), np.array(parts[3], np.int64), capacity, slack))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=None) if (batches := list(batches)) else None
        if table is not None and table.num_rows:
            totals, lists = table["total"].combine_chunks(), table["members"].combine_chunks()
            lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
            counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            yield from _sliced(_bins(lists.flatten(), counts, totals.to_numpy().astype(np.int64), capacity, slack))

    done, rest = [], saved(rows_without_columns(docs, ["doc_id", "text"]).mapInArrow(first, _BINS), "pack")
    parts, last = None, None
    while True:
        done.append(rest.filter("full"))
        open_bins = rest.filter("not full")
        n = open_bins.count()
        least = -(-n // TASK_BINS)
        if n == 0 or parts == 1 or (parts is not None and parts <= least and n > 0.99 * last):
            done.append(open_bins)
            break
        parts = max(1, least, -(-(parts or max(FAN_IN, rest.rdd.getNumPartitions())) // FAN_IN))
        last = n
        rest = saved(open_bins.repartition(parts).sortWithinPartitions(F.desc("total"), F.col("members")[0]["doc_id"], F.col("members")[0]["piece"]).mapInArrow(again, _BINS), "pack")
    whole = done[0]
    for more in done[1:]:
        whole = whole.union(more)
    return (
        whole.withColumn("sequence_id", F.monotonically_increasing_id())
        .select("sequence_id", "total", F.inline("members"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "total")
    )
