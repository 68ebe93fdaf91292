"""Fuzzy line deduplication.

Lines are normalised (words in lower case, digits as 0, punctuation gone). Equal
normalised lines are one node from the start. Two lines are linked where the edit
similarity of their normalised texts is at least 0.9.

Candidates come from SimHash blocks. A line has a SimHash of ``BITS`` bits for each of B
blocks, to which its words are dealt by their hashes; the blocks' sums make up the SimHash
of the whole line. A changed word touches two blocks at most (the old and the new one's),
so by the pigeonhole principle two lines that differ in fewer than B / 2 words agree in a
block, and with more changes they do with a probability: B grows with the line
(``blocks_for``). A key is one block, or, of lines with fewer than 16 words, two of five
blocks. Lines of up to 8 words have keys that leave out one word or two in a row. Lines of at most
``SHORT`` characters are cut into pieces instead, one more than there may be edits, and
lose no pair. Members of a bucket whose lengths differ too much, or whole SimHashes in more
than ``MOST_BITS`` bits, are no candidates.

Candidates are confirmed on the texts. Every line is tried with the smallest member of
its buckets that it shares most keys with; lines of a bucket that are then in different
components are compared with each other in blocks of bounded size, where the texts are
read, and only links leave a block. Of every connected group of lines the first occurrence
(smallest doc_id, then line number) is kept.

Nodes are 64-bit hashes of the normalised line (a second 64 bits keep unequal lines
apart when they are counted).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import EDGES_A_TASK, components, discard, group_runs, saved, small_batches, tiles
from .edits import WORDS, Coded, within

SIMILARITY = 0.9
SHORT = 29  # characters up to which pairs are found by pieces
FROM = 27  # characters from which lines have SimHash keys: the least that is like one of SHORT + 1
FEW = 8  # words up to which a line has keys that leave out a word or two
LONG = 4  # characters of the words that have a part in SimHashes, where a line has 8 such words
LETTERS = 10  # characters that a block's words must have for a key
BITS = 32  # of a SimHash
MOST_BITS = 11  # that may differ in the SimHash of whole lines of LINE_WORDS words or more; half differ between unlike lines
LINE_WORDS = 16
BLOCK = 1024  # rows of a bucket compared at a time
SEGMENT = 1 << 20  # bytes hashed at a time, about
PAIRS = 256
SEEN = 200_000  # nodes that a task remembers, so that a common line gives its keys once

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))
#: Of every byte of lower-case UTF-8: digits as 0, what is neither a word character nor a line feed as a blank.
_CLEAN = bytes(48 if 48 <= c < 58 else c if c >= 128 or c in (10, 95) or 97 <= c < 123 or 65 <= c < 91 else 32 for c in range(256))
_SPREAD = np.array([int.from_bytes(bytes(x >> k & 1 for k in range(8)), "little") for x in range(256)], np.uint64)
_EMPTY = np.zeros(0, np.int64)


def cleaned(text: str) -> bytes:
    """Words of ``text`` in lower case, digits as 0, each other character but the line feed a blank."""
    text = text.lower()
    if not text.isascii():
        for c in set(text):
            if c > "\x7f" and not c.isalpha():
                text = text.replace(c, "0" if c.isdecimal() else c if c.isalnum() else " ")
    return text.encode("utf-8", "surrogatepass").translate(_CLEAN)


def normalised(line: str) -> str:
    return b" ".join(cleaned(line).split()).decode("utf-8", "surrogatepass")


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _MIX[0]
        h = (h ^ (h >> np.uint64(29))) * _MIX[1]
        return h ^ (h >> np.uint64(32))


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(SEGMENT, base, np.uint64)], dtype=np.uint64)


_UP = _powers(0x9E3779B97F4A7C15)
_DOWN = _powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Lines:
    """The words of cleaned lines, as arrays.

    ``word`` has the hash of every word, ``at`` where each line's words begin (and the
    end), ``size`` the characters of each normalised line, ``node`` and ``second`` its keys.
    A line's words are bytes of ``raw`` from ``begin`` to ``end``.
    """

    def __init__(self, raw: bytes):
        self.raw = raw
        chars = np.frombuffer(raw + b"\n", np.uint8)
        gap = (chars == 32) | (chars == 10)
        self.begin = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
        self.end = np.flatnonzero(gap & np.r_[False, ~gap[:-1]])
        feeds = np.flatnonzero(chars == 10)
        self.at = np.r_[0, np.searchsorted(self.begin, feeds)]
        self.n = np.diff(self.at)
        self.word = self._hashes(chars)
        long = np.cumsum((chars & 0xC0) != 0x80, dtype=np.int64)
        long = long[self.end - 1] - long[self.begin] + 1 if len(self.begin) else _EMPTY
        self.size = self.sums(long) + np.maximum(self.n - 1, 0)
        self.long = long
        self.n_long = self.sums((long >= LONG).astype(np.int64))
        with np.errstate(over="ignore"):
            placed = self.word + (np.arange(len(self.word)) - np.repeat(self.at[:-1], self.n)).astype(np.uint64) * _ODD
            self.node = mixed(self.sums(mixed(placed))).view(np.int64)
            self.second = mixed(self.sums(mixed(placed ^ _MIX[1])) + _ODD).view(np.int64)

    def _hashes(self, chars: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.begin), np.uint64)
        at = 0
        with np.errstate(over="ignore"):
            while at < len(out):
                base = self.begin[at]
                stop = int(np.searchsorted(self.end, base + SEGMENT, side="right"))
                if stop == at:  # one word longer than a segment
                    out[at] = xxhash.xxh64_intdigest(self.raw[base : self.end[at]])
                    at += 1
                    continue
                part = chars[base : self.end[stop - 1]]
                total = np.r_[np.uint64(0), np.cumsum(part * _UP[: len(part)], dtype=np.uint64)]
                lo, hi = self.begin[at:stop] - base, self.end[at:stop] - base
                out[at:stop] = (total[hi] - total[lo]) * _DOWN[lo]
                at = stop
        return mixed(out)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of one value for each word, the sum for each line."""
        with np.errstate(over="ignore"):
            total = np.r_[np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)]
            return total[self.at[1:]] - total[self.at[:-1]]

    def text(self, k: int) -> str:
        lo, hi = self.at[k], self.at[k + 1]
        return b" ".join(self.raw[self.begin[lo] : self.end[hi - 1]].split()).decode("utf-8", "surrogatepass") if hi > lo else ""

    def words_of(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of some lines, and of each the place of its line among those."""
        n = self.n[lines]
        own = np.repeat(np.arange(len(lines)), n)
        return np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.at[lines], n), own


def pieces(name: str) -> set[int]:
    """Keys of a line of at most SHORT characters: two lines that reach SIMILARITY share one, whichever edits there are."""
    n, out = len(name), set()
    for longer in range(n, SHORT + 1):
        edits = longer // 10
        if longer - n > edits:
            break
        cut = [longer * i // (edits + 1) for i in range(edits + 2)]
        for i in range(edits + 1 if edits else 0):
            begin, size = cut[i], cut[i + 1] - cut[i]
            # at most i edits before the piece, or else at most edits - i after it
            low = max(0, begin - i, begin + n - longer - (edits - i))
            high = min(n - size, begin + i, begin + n - longer + (edits - i))
            out.update(xxhash.xxh64_intdigest(f"{longer} {i} {name[k : k + size]}".encode("utf-8", "surrogatepass")) for k in range(low, high + 1))
    return out


def blocks_for(level: int) -> int:
    """Blocks of lines with 8 * 2^level words or more: with twice the words, 1.57 times the blocks."""
    return 5 if level == 0 else round(6 * 1.57 ** (level - 1))


def simhash(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The SimHash of BITS bits, from how many of ``n`` features have each bit."""
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view(np.uint32).ravel()


def block_sums(word: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words in groups: the groups in order, how many words each has, and how many of them have each bit."""
    packed = np.sort(group.astype(np.uint64) << np.uint64(40) | word >> np.uint64(24))
    group = (packed >> np.uint64(40)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    n = np.diff(np.r_[first, len(group)])
    within = np.arange(len(group)) - np.repeat(first, n)
    runs = np.flatnonzero(within % 255 == 0)  # counters of 8 bits hold as many
    parts = [np.add.reduceat(_SPREAD[(packed >> np.uint64(8 * k)) & np.uint64(255)], runs).view(np.uint8).reshape(-1, 8) for k in range(BITS // 8)]
    counts = np.concatenate(parts, axis=1).astype(np.int32)
    if len(runs) > len(first):
        counts = np.add.reduceat(counts, np.searchsorted(runs, first))
    return group[first], n, counts


def block_keys(lines: Lines, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines in ``which`` (all with a word): the row and the key of all keys, and the value of each line.

    The value is its length in characters, above whether it has LINE_WORDS words, above
    its SimHash.
    """
    n, size = lines.n[which], lines.size[which]
    value = np.minimum(size, (1 << 24) - 1) << 33 | (lines.n_long[which] >= LINE_WORDS).astype(np.int64) << 32
    rows, keys = [], []
    for k in np.flatnonzero(size <= SHORT):
        found = pieces(lines.text(which[k]))
        rows.append(np.full(len(found), k))
        keys.append(np.fromiter(found, np.uint64, len(found)))
    with np.errstate(over="ignore"):
        some = np.flatnonzero((size >= FROM) & (n <= FEW) & (n > 1))
        if len(some):
            words, own = lines.words_of(which[some])
            h = mixed(lines.word[words])
            total = np.zeros(len(some), np.uint64)
            np.add.at(total, own, h)
            pair = np.flatnonzero((own[1:] == own[:-1]) & (n[some][own[1:]] > 2))  # a blank more or less changes two words into one
            rows += [some[own], some, some[own[pair]]]
            keys += [mixed(total[own] - h), mixed(total), mixed(total[own[pair]] - h[pair] - h[pair + 1])]
        many = lines.n_long[which]
        for least, n_kind, kind in ((LONG, many, many >= 7), (0, n, (many < 8) & (n > 7))):
            level, most = 0, n_kind[kind].max(initial=0)
            while 7 * 2**level <= most:
                low, high, blocks = 8 << level, 16 << level, blocks_for(level)
                some = np.flatnonzero(kind & (size >= FROM) & (n_kind >= low * 7 // 8) & (n_kind < high))
                level += 1
                if not len(some):
                    continue
                words, own = lines.words_of(which[some])
                if least:
                    told = lines.long[words] >= least
                    words, own = words[told], own[told]
                word = lines.word[words]
                group = own * blocks + ((word & np.uint64(0xFFFFFF)) % np.uint64(blocks)).astype(np.int64)
                held = np.bincount(group, lines.long[words], minlength=len(some) * blocks).astype(np.int64)
                group, count, counts = block_sums(word, group)
                held = held[group]
                line, block = np.divmod(group, blocks)
                mine = mixed(simhash(counts, count).astype(np.uint64) | count.astype(np.uint64) << np.uint64(32)) + (block.astype(np.uint64) + np.uint64(1)) * _ODD + np.uint64(blocks * 2 + (least > 0))
                if level == 1:  # two blocks each
                    table, full = np.zeros((len(some), blocks), np.uint64), np.zeros((len(some), blocks), np.int64)
                    table[line, block], full[line, block] = mixed(mine), held
                    for i in range(blocks):
                        for j in range(i):
                            good = full[:, i] + full[:, j] >= LETTERS
                            rows.append(some[good])
                            keys.append(mixed(table[good, i] + table[good, j] + np.uint64(i * blocks + j)))
                else:
                    good = held >= LETTERS
                    rows.append(some[line[good]])
                    keys.append(mixed(mine[good]))
                first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
                whole = simhash(np.add.reduceat(counts, first), np.add.reduceat(count, first))
                value[some] = value[some] >> 32 << 32 | whole.astype(np.int64)
    none = np.zeros(0, np.uint64)
    return np.concatenate([_EMPTY, *rows]), np.concatenate([none, *keys]).view(np.int64), value


def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the values of lines, which can be alike: by length and, if neither has few words, by SimHash."""
    a, b = x >> 33, y >> 33
    few = ((x & y) >> 32 & 1) == 0
    bits = np.bitwise_count((x ^ y) & ((1 << BITS) - 1))
    return (10 * np.abs(a - b) <= np.maximum(a, b)) & (few | (bits <= MOST_BITS))


def _near(x: str, y: str):
    """``near`` as a column."""
    a, b = F.shiftright(x, 33), F.shiftright(y, 33)
    few = F.col(x).bitwiseAND(F.col(y)).bitwiseAND(F.lit(1 << 32)) == 0
    bits = F.bit_count(F.col(x).bitwiseXOR(F.col(y)).bitwiseAND(F.lit((1 << BITS) - 1)))
    return (10 * F.abs(a - b) <= F.greatest(a, b)) & (few | (bits <= MOST_BITS))


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance by bit-parallel columns (one machine-independent long integer for each)."""
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    a, b = a[start : len(a) - stop], b[start : len(b) - stop]
    if not a or not b:
        return len(a) + len(b)
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, d = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        same = eq | down
        cross = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (full & ~(cross | up)), up & cross
        if plus & top:
            d += 1
        elif minus & top:
            d -= 1
        plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(same | plus)), plus & same
    return d


def common(a: str, b: str) -> int:
    """The length of the longest common subsequence, by bits as in ``edit_distance`` but with fewer operations."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    rest = full
    for c in b:
        hit = rest & where.get(c, 0)
        rest = (rest + hit) | (rest - hit)
    return len(a) - (rest & full).bit_count()


def alike(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    """Whether the edit similarity is reached: 1 - distance / the longer length."""
    most = max(len(a), len(b))
    allowed = int((1 - similarity) * most + 1e-9)
    if abs(len(a) - len(b)) > allowed:
        return False
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y) and sum(max(len(p), len(q)) for p, q in zip(x, y, strict=True) if p != q) <= allowed:
        return True  # no more than writing the differing words anew
    if most > 49 and (len(a) + len(b)) / 2 - common(a, b) > allowed:
        return False  # with d edits, half of both lengths less the common characters is d at most
    return edit_distance(a, b) <= allowed


def alike_pairs(lines: list[str], coded: Coded, a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """``alike`` for pairs of places in ``lines``: at once, but for the longest lines."""
    allowed = ((1 - similarity) * np.maximum(coded.size[a], coded.size[b]) + 1e-9).astype(np.int64)
    out = np.zeros(len(a), bool)
    many = allowed < 64 * WORDS
    out[many] = within(coded, a[many], b[many], allowed[many])
    for k in np.flatnonzero(~many):
        out[k] = alike(lines[a[k]], lines[b[k]], similarity)
    return out


def _counts(coded: Coded) -> np.ndarray:
    """Of each line, how many pairs of neighbouring characters fall into each of PAIRS places.

    An edit takes away two pairs and adds two at most, so lines whose counts differ by more
    than four for each edit allowed are not alike.
    """
    out = np.zeros((len(coded.size), PAIRS), np.int32)
    lo = 0
    while lo < len(out):
        hi = max(lo + 1, int(np.searchsorted(coded.at, coded.at[lo] + SEGMENT, "right")) - 1)
        c, n = coded.chars[coded.at[lo] : coded.at[hi]], coded.size[lo:hi]
        own = np.repeat(np.arange(hi - lo), n)
        same = own[1:] == own[:-1]
        place = (c[:-1] * np.uint32(31) + c[1:]) % np.uint32(PAIRS)
        out[lo:hi] = np.bincount(own[1:][same] * PAIRS + place[same], minlength=(hi - lo) * PAIRS).reshape(-1, PAIRS)
        lo = hi
    return out


def pair_counts(lines: list[str]) -> np.ndarray:
    return _counts(Coded(lines))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text, which tells apart rows that repeat an id; rows without id take no part."""
    small_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").filter("doc_id is not null")


def _lines_of(batch: pa.RecordBatch) -> tuple[Lines, np.ndarray, np.ndarray]:
    """All lines of a batch, and of each its row and its number within the row's text."""
    texts = [t or "" for t in batch.column(2).to_pylist()]
    sizes = np.array([t.count("\n") + 1 for t in texts], np.int64)
    rows = np.repeat(np.arange(len(texts)), sizes)
    return Lines(b"\n".join(map(cleaned, texts))), rows, (np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)


HELD_ROWS = 1 << 19  # rows of keys, or of lines, that a task holds before it deals them
BUCKETS = 4096  # that keys and nodes are dealt to
TOGETHER = 1 << 18  # rows that are sorted together, unless one bucket has more
PART = 4096  # rows of a batch
#: Kinds of rows: doc_id, text_key, line_no, node, second; node, second, doc_id, line_no, text_key, how many; key, node, sim and, in the end, the key's first node and its sim.
_LINE, _NODE, _KEY = 0, 1, 2
_WIDTH = (5, 6, 3)


def _dealt(kind: int, rows: np.ndarray) -> pa.RecordBatch:
    """Rows as bytes, those of a bucket together: by their first column, or lines, which any bucket can have, in parts."""
    if kind == _LINE:
        first = np.arange(0, len(rows), PART // 8)
        bucket = (rows[first, 3].view(np.uint64) >> np.uint64(52)).astype(np.int32)
    else:
        of = (rows[:, 0].view(np.uint64) >> np.uint64(52)).astype(np.uint16)
        order = np.argsort(of, kind="stable")
        rows, of = rows[order], of[order]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        bucket = of[first].astype(np.int32)
    ends = (np.r_[first, len(rows)] * 8 * _WIDTH[kind]).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), kind, np.int32)), pa.array(bucket), packed], ["kind", "bucket", "packed"])


def _firsts(rows: np.ndarray) -> np.ndarray:
    """Of rows (node, second, doc_id, line_no, text_key, how many), one for each node and second: the first place, and how many in all."""
    rows = rows[np.lexsort(rows.T[4::-1])]
    first = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)])
    out = rows[first]
    out[:, 5] = np.add.reduceat(rows[:, 5], first)
    return out


def _shared(keys: np.ndarray) -> np.ndarray:
    """Of all rows (key, node, sim) of some keys: those of keys that more than one node has, with the key's first node and its sim; repeated ones once."""
    order = np.argsort(keys[:, 0])
    key = keys[order, 0]
    same = key[1:] == key[:-1]
    keys = keys[order[np.r_[False, same] | np.r_[same, False]]]
    keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
    keys = keys[np.r_[True, (keys[1:, :2] != keys[:-1, :2]).any(1)][: len(keys)]]
    first = np.flatnonzero(np.r_[True, keys[1:, 0] != keys[:-1, 0]][: len(keys)])
    size = np.diff(np.r_[first, len(keys)])
    return np.concatenate([keys, keys[np.repeat(first, size), 1:]], axis=1)[np.repeat(size > 1, size)]


def _met(docs: DataFrame) -> DataFrame:
    """As bytes, dealt to buckets: every line with a word, its node, and the keys and sim (the value of ``block_keys``) of nodes that the task has not met before."""

    def dealt(places: list[np.ndarray], keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if places:
            lines = np.concatenate(places)
            yield _dealt(_LINE, lines)
            yield _dealt(_NODE, _firsts(np.concatenate([lines[:, [3, 4, 0, 2, 1]], np.ones((len(lines), 1), np.int64)], axis=1)))
        if sum(map(len, keys)):
            yield _dealt(_KEY, np.concatenate(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        for batch in batches:
            if not batch.num_rows:
                continue
            lines, rows, numbers = _lines_of(batch)
            some = np.flatnonzero(lines.n)
            if not len(some):
                continue
            node, of = lines.node[some], rows[some]
            new = np.zeros(len(some), bool)
            new[np.unique(node, return_index=True)[1]] = True
            new[new] = [x not in seen for x in node[new].tolist()]
            if len(seen) + new.sum() > SEEN:
                seen.clear()
            seen.update(node[new].tolist())
            at, keys, value = block_keys(lines, some[new])
            held[0].append(np.stack([batch.column(0).to_numpy()[of], batch.column(1).to_numpy()[of], numbers[some].astype(np.int64), node, lines.second[some]], axis=1))
            held[1].append(np.stack([keys, node[new][at], value[at]], axis=1))
            if max(sum(map(len, h)) for h in held) >= HELD_ROWS:
                yield from dealt(*held)
                held = ([], [])
        yield from dealt(*held)

    return _keyed(docs).mapInArrow(run, "kind int, bucket int, packed binary")


def occurrences(docs: DataFrame) -> DataFrame:
    """kind, a, b, c, d, e, f: every line with a word, every node with its first place, and the keys that several nodes share (``_LINE``, ``_NODE``, ``_KEY``).

    Rows go through the shuffle as bytes, many at a time, as most keys are of one line
    only and end there. A task sorts the rows of whole buckets, some at a time; a bucket
    has about a BUCKETS-th of all, and of a very common line or key a row for each node
    and task at most.
    """
    met = _met(docs)

    def made(kind: int, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = rows.reshape(-1, _WIDTH[kind])
        table = _firsts(table) if kind == _NODE else _shared(table) if kind == _KEY else table
        for k in range(0, len(table), PART):
            part = np.zeros((6, min(PART, len(table) - k)), np.int64)
            part[: table.shape[1]] = table[k : k + PART].T
            yield pa.RecordBatch.from_arrays([pa.array(np.full(part.shape[1], kind, np.int32)), *map(pa.array, part)], ["kind", *"abcdef"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, last = [], 0, (-1, -1)
        for batch in batches:
            for kind, bucket, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (kind != last[0] or bucket != last[1] and n >= TOGETHER * 8 * _WIDTH[kind]):
                    yield from made(last[0], np.frombuffer(b"".join(held), np.int64))
                    held, n = [], 0
                last = (kind, bucket)
                held.append(packed)
                n += len(packed)
        if held:
            yield from made(last[0], np.frombuffer(b"".join(held), np.int64))

    return met.repartition("bucket").sortWithinPartitions("kind", "bucket").mapInArrow(run, "kind int, a long, b long, c long, d long, e long, f long")


def _texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(node, line): the normalised lines of the places (node, doc_id, text_key, line_no).

    Of a document its text comes first, then its places, in batches of any size.
    """
    texts = _keyed(docs).select("doc_id", "text_key", F.lit(-1).alias("line_no"), F.lit(None).cast("long").alias("node"), "text")
    both = texts.union(places.select("doc_id", "text_key", "line_no", "node", F.lit(None).cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, parts = "", None
        for batch in batches:
            nodes, lines = [], []
            for number, node, new in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number < 0:
                    text, parts = new, None
                    continue
                parts = parts or text.split("\n")
                nodes.append(node)
                lines.append(normalised(parts[number]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(lines, pa.string())], ["node", "line"])

    return both.repartition("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", "line_no").select("line_no", "node", "text").mapInArrow(run, "node long, line string")


def confirm(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose normalised lines reach the edit similarity."""
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("line").alias("lb")), "b").join(texts.select(F.col("node").alias("a"), F.col("line").alias("la")), "a").select("a", "b", "la", "lb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, n = batch.column(2).to_pylist() + batch.column(3).to_pylist(), batch.num_rows
            keep = alike_pairs(lines, Coded(lines), np.arange(n), np.arange(n, 2 * n), similarity)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return saved(both.mapInArrow(run, "a long, b long"), "links")


TILE = ("key", "ta", "tb")
_TILED = "key long, ta int, tb int, lo long, mine int, node long, root long, sim long"
KNOWN = 1_000_000  # pairs that a task remembers as unlike, so as not to compare them again
AT_ONCE = 1 << 18  # pairs of rows that are looked at together
HELD = 8 << 20  # bytes of rows with lines that are compared together, about


def _open_pairs(columns: dict[str, np.ndarray], starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of tiles: pairs of rows of different components that can be alike, some at a time."""
    n = np.diff(starts)
    tile = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((columns["root"], tile))  # a row's partners follow the rows of its component
    root = columns["root"][order]
    last = np.flatnonzero(np.r_[(tile[1:] != tile[:-1]) | (root[1:] != root[:-1]), True]) + 1
    begin = np.repeat(last, np.diff(np.r_[0, last]))
    count = np.repeat(starts[1:], n) - begin
    ends = np.cumsum(count)
    lo = 0
    while lo < len(order):
        done = ends[lo] - count[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
        some = count[lo:hi]
        if ends[hi - 1] > done:
            i = np.repeat(np.arange(lo, hi), some)
            j = np.arange(len(i)) - np.repeat(ends[lo:hi] - some - done, some) + begin[i]
            i, j = order[i], order[j]
            good = near(columns["sim"][i], columns["sim"][j])
            i, j = i[good], j[good]
            good = (columns["ta"][i] == columns["tb"][i]) | (columns["mine"][i] != columns["mine"][j])
            yield i[good], j[good]
        lo = hi


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of tiles that have a candidate in another component."""
    at = members.select("key", "node", "sim").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    at = saved(at, "labelled")
    several = at.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key", "lo")
    rows = tiles(at.join(several, "key"), "key", "node", BLOCK).select(*TILE, "lo", "mine", "node", "root", "sim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in group_runs(batches, TILE):
            columns = {c: table[c].to_numpy() for c in table.column_names}
            hit = np.zeros(table.num_rows, bool)
            for i, j in _open_pairs(columns, starts):
                hit[i] = True
                hit[j] = True
            if hit.any():
                yield from table.filter(pa.array(hit)).to_batches()

    out = saved(rows.repartition(*TILE).sortWithinPartitions(*TILE, "node").mapInArrow(run, _TILED), "open")
    discard(at)
    return out


def _large(tables: Iterator[tuple[pa.Table, np.ndarray]]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of ``group_runs``, several as one up to HELD bytes."""
    held: list[tuple[pa.Table, np.ndarray]] = []

    def whole() -> tuple[pa.Table, np.ndarray]:
        before = np.cumsum([0, *(t.num_rows for t, _ in held)])
        return pa.concat_tables([t for t, _ in held]).combine_chunks(), np.concatenate([*(s[:-1] + n for (_, s), n in zip(held, before, strict=False)), before[-1:]])

    for table, starts in tables:
        if held and sum(t.nbytes for t, _ in held) + table.nbytes > HELD:
            yield whole()
            held = []
        held.append((table, starts))
    if held:
        yield whole()


def _between(rows: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between components, from comparing the lines of open rows within tiles.

    Tiles of buckets with the same smallest component go to one task, block by block, as
    they hold much the same lines: components that a task has joined are not compared
    again, nor are pairs that it found unlike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined: dict[int, int] = {}
        unlike: set[tuple[int, int]] = set()

        def top(r: int) -> int:
            while r in joined:
                r = joined[r]
            return r

        def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            """Whether two components are not joined yet."""
            roots, at = np.unique(np.r_[p, q], return_inverse=True)
            tops = np.array([top(r) for r in roots.tolist()], np.int64)[at]
            return tops[: len(p)] != tops[len(p) :]

        for table, starts in _large(group_runs(batches, ("lo", *TILE))):
            columns = {c: table[c].to_numpy() for c in table.column_names if c != "line"}
            root, sim, a, b = columns["root"], columns["sim"], [], []
            node, at, of = np.unique(columns["node"], return_index=True, return_inverse=True)  # a node's line once
            line = table["line"].take(pa.array(at)).to_pylist()
            coded = Coded(line)
            counts = _counts(coded)
            for i, j in _open_pairs(columns, starts):
                x, y = np.minimum(of[i], of[j]), np.maximum(of[i], of[j])
                first = np.unique(x * len(node) + y, return_index=True)[1]
                first = first[apart(root[i[first]], root[j[first]])]
                i, j, x, y = i[first], j[first], x[first], y[first]
                most = 4 * np.floor((1 - similarity) * np.maximum(coded.size[x], coded.size[y]) + 1e-9)
                good = np.concatenate([np.zeros(0, bool), *(np.abs(counts[x[k : k + 4096]] - counts[y[k : k + 4096]]).sum(1) <= most[k : k + 4096] for k in range(0, len(x), 4096))])
                good[good] = [pair not in unlike for pair in zip(node[x[good]].tolist(), node[y[good]].tolist(), strict=True)]
                i, j, x, y = i[good], j[good], x[good], y[good]
                order = np.lexsort((np.bitwise_count((sim[i] ^ sim[j]) & ((1 << BITS) - 1)), x))
                i, j, x, y = i[order], j[order], x[order], y[order]
                rank = np.arange(len(x)) - np.searchsorted(x, x)  # of a line's pairs, the likeliest first
                limit = 2
                while len(x):
                    now = rank < limit
                    found = alike_pairs(line, coded, x[now], y[now], similarity)
                    for p, q, u, v, hit in zip(root[i[now]].tolist(), root[j[now]].tolist(), node[x[now]].tolist(), node[y[now]].tolist(), found.tolist(), strict=True):
                        if not hit:
                            if len(unlike) >= KNOWN:
                                unlike.clear()
                            unlike.add((u, v))
                        elif (p := top(p)) != (q := top(q)):
                            joined[p] = q
                            a.append(u)
                            b.append(v)
                    rest = np.flatnonzero(~now)
                    rest = rest[apart(root[i[rest]], root[j[rest]])]
                    i, j, x, y, rank = i[rest], j[rest], x[rest], y[rest], rank[rest]
                    limit *= 8
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    with_lines = rows.join(texts, "node").select("lo", *TILE, "mine", "node", "root", "sim", "line")
    small_batches(rows)
    return saved(with_lines.repartition("lo", "ta", "tb").sortWithinPartitions("lo", *TILE, "node").mapInArrow(run, "a long, b long"), "links")


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components, few rounds from being stars: every task makes stars of its own edges.

    A task has about EDGES_A_TASK edges; ``components`` joins up what several tasks have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(r: int) -> int:
            end = r
            while (above := up.setdefault(end, end)) != end:
                end = above
            while r != end:
                up[r], r = end, up[r]
            return end

        for batch in batches:
            for p, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p, q = top(p), top(q)
                up[max(p, q)] = min(p, q)
        a = [r for r in up if up[r] != r]
        for k in range(0, len(a), 20_000):
            part = a[k : k + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([top(r) for r in part], pa.int64())], ["a", "b"])

    return edges.coalesce(1 + edges.count() // EDGES_A_TASK).mapInArrow(run, "a long, b long")


def line_groups(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The occurrences of all lines; the distinct lines with first place and number; (node, root) of lines in a group with others."""
    whole = saved(occurrences(docs), "occurrences")

    def rows(kind: int, *names: str) -> DataFrame:
        return whole.filter(F.col("kind") == kind).select(*[F.col(c).cast("int" if n == "line_no" else "long").alias(n) for c, n in zip("abcdef", names, strict=False)])

    lines = rows(_LINE, "doc_id", "text_key", "line_no", "node", "second")
    nodes = rows(_NODE, "node", "second", "doc_id", "line_no", "text_key", "n").select("node", "second", F.struct("doc_id", "line_no", "text_key").alias("at"), "n")
    members = rows(_KEY, "key", "node", "sim", "a", "sa")
    shared = members.filter("node <> a").filter(_near("sim", "sa")).groupBy("a", "node").agg(F.count("*").alias("n"))
    first = saved(shared.groupBy(F.col("node").alias("b")).agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b"), "pairs")
    wanted = nodes.select("node", "at.*").join(members.select("node").distinct(), "node", "left_semi")
    texts = saved(_texts(docs, wanted), "texts")
    links = confirm(first, texts, similarity)
    discard(first)
    roots = components(_contracted(links), "lines")
    open_rows = _open(members, roots)
    if not open_rows.isEmpty():
        known = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = components(_contracted(known.union(_between(open_rows, texts, similarity))), "lines")
    discard(open_rows)
    discard(texts)
    return lines, nodes, roots


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """All columns of ``docs``, with the text less the repeated lines, ``n_lines`` and ``n_dropped``.

    Needs ``doc_id`` and ``text``; a column named n_chars is brought up to date, columns
    named n_lines and n_dropped are replaced, others stay as they are whatever their
    names. Lines without a word (blank ones too) are never dropped. A null text stays
    null; rows without doc_id are left alone and affect no others. Rows that repeat doc_id
    and text are one document. A document whose lines all go keeps an empty text. An empty
    table gives no rows.
    """
    lines, nodes, roots = line_groups(docs, similarity)
    # a line that others are like is kept at the group's first place, one that only repeats at its own
    grouped = nodes.join(roots, "node").select("node", "second", "root", "at")
    firsts = grouped.groupBy("root").agg(F.min("at").alias("first"))
    active = grouped.join(firsts, "root").select("node", "second", "first").union(nodes.filter("n > 1").join(roots.select("node"), "node", "left_anti").select("node", "second", F.col("at").alias("first")))
    gone = lines.join(active, ["node", "second"]).filter(F.struct("doc_id", "line_no", "text_key") != F.col("first")).select("doc_id", "text_key", "line_no")
    drops = gone.groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("drops"))
    # every column of the input in one struct, so that no name can clash
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    joined = whole.join(drops.hint("shuffle_hash"), ["doc_id", "text_key"], "left")
    parts = F.split("row.text", "\n", -1)
    kept = F.filter(parts, lambda x, i: ~F.array_contains(F.col("drops"), i))
    text = F.when(F.col("drops").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    out = joined.select("row", text.alias("left"), F.greatest(F.coalesce(F.size(parts), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"), F.greatest(F.coalesce(F.size("drops"), F.lit(0)), F.lit(0)).cast("long").alias("n_dropped"))
    columns = [F.col("left").alias("text") if c == "text" else F.length("left").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*columns, "n_lines", "n_dropped")
