"""Edit distances of many pairs of lines at once, exact, by bits in arrays.

A pair has a band of diagonals: where ``allowed`` edits turn one line into the other, no
cell of the way there is farther off. One step takes all pairs of a batch one character
on (Hyyrö's bit vectors, which slide with the band), and a pair ends as soon as the
diagonal of its last cell, which never falls, is over ``allowed``.
"""

from __future__ import annotations

import numpy as np

WORDS = 4  # of 64 diagonals that a band may have; bands of more edits are for big integers, one pair at a time
BATCH = 4096  # words of all bands that take a step together
_ONE, _LAST, _ALL = np.uint64(1), np.uint64(63), ~np.uint64(0)


class Coded:
    """Lines as one array of characters, ``at`` where each begins (and the end), ``size`` their lengths."""

    def __init__(self, lines: list[str]):
        self.size = np.array([len(x) for x in lines], np.int64)
        self.at = np.r_[0, np.cumsum(self.size)]
        self.chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        found = np.zeros(int(self.chars.max(initial=0)) + 1, bool)
        found[self.chars] = True
        code = np.cumsum(found)  # from 1: 0 is like no character
        self.code = code.astype(np.uint8 if code[-1] < 256 else np.uint32)[self.chars]

    def rows(self, lines: np.ndarray, shift: np.ndarray, width: int) -> np.ndarray:
        """The codes of some lines as rows, each from column ``shift`` on."""
        out = np.zeros((len(lines), width), self.code.dtype)
        n = self.size[lines]
        own = np.repeat(np.arange(len(lines)), n)
        k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        out[own, k + shift[own]] = self.code[k + self.at[lines][own]]
        return out


def within(lines: Coded, a: np.ndarray, b: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Of pairs of places (a, b), whether ``allowed`` edits, less than 64 * WORDS, turn one line into the other."""
    swap = lines.size[a] < lines.size[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    more = lines.size[a] - lines.size[b]
    out = (more <= allowed) & (lines.size[b] == 0)
    some = np.flatnonzero((more <= allowed) & (lines.size[b] > 0))
    words = allowed[some] // 64 + 1
    order = np.lexsort((lines.size[b[some]], words))
    some, words = some[order], words[order]
    lo = 0
    while lo < len(some):
        w = int(words[lo])
        k = some[lo : min(lo + max(1, BATCH // w), int(np.searchsorted(words, w, "right")))]
        out[k] = _within(lines, a[k], b[k], allowed[k], w)
        lo += len(k)
    return out


def _within(lines: Coded, a: np.ndarray, b: np.ndarray, allowed: np.ndarray, w: int) -> np.ndarray:
    """``within`` of pairs in order of the length of b, which is no longer than a, with bands of ``w`` words.

    Bit t of a band at column c is row c - below + t of the table, ``up`` and ``down`` have
    where the distance grows or falls from the row before, ``d0`` where it stays along the
    diagonal; ``left`` is what the last cell's diagonal may still grow.
    """
    n, more = lines.size[b], lines.size[a] - lines.size[b]
    below = (allowed - more) // 2
    steps = int(n[-1])
    rows = lines.rows(a, below, max(int((lines.size[a] + below).max()), steps + 64 * w))
    columns = np.ascontiguousarray(lines.rows(b, np.zeros_like(below), steps).T)
    out, own, left = np.zeros(len(a), bool), np.arange(len(a)), allowed - more
    word, bit = (more + below) // 64, ((more + below) % 64).astype(np.uint64)
    skip = np.clip(below - 64 * np.arange(w)[:, None], 0, 64)
    up = np.where(skip > 63, np.uint64(0), _ALL << np.minimum(skip, 63).astype(np.uint64))
    down = np.zeros_like(up)
    ended = 0
    for c in range(steps):
        eq = np.packbits((rows[:, c : c + 64 * w] == columns[c][:, None]).ravel(), bitorder="little").view("<u8")
        eq = eq.reshape(-1, w).T if w > 1 else eq[None]
        total = (eq & up) + up
        if w > 1:
            over = total < up
            for k in range(1, w):
                total[k] += over[k - 1]
                over[k] |= over[k - 1] & (total[k] == 0)
        d0 = (total ^ up) | eq | down
        left -= 1
        left += ((d0[0] if w == 1 else d0[word, np.arange(len(word))]) >> bit & _ONE).view(np.int64)
        after = d0 >> _ONE
        if w > 1:
            after[:-1] |= d0[1:] << _LAST
        grows = down | ~(d0 | up)
        up &= d0
        up |= ~(after | grows)
        down = after & grows
        if n[ended] == c + 1:
            end = int(np.searchsorted(n, c + 1, "right"))
            out[own[ended:end]] = left[ended:end] >= 0
            ended = end
            if ended == len(n):
                break
        if c % 16 == 15:
            keep = left >= 0
            keep[:ended] = False
            if not keep.any():
                break
            if keep.sum() < 0.8 * len(keep):
                rows, columns, up, down = rows[keep], np.ascontiguousarray(columns[:, keep]), up[:, keep], down[:, keep]
                own, left, word, bit, n, ended = own[keep], left[keep], word[keep], bit[keep], n[keep], 0
    return out
