"""Burrows-Wheeler transform and common prefixes of many strings at once, built column by column.

Round j inserts the suffix of length j of every string: one symbol a string. The transform (one symbol a
suffix) and the common prefix of each suffix with the one before it lie in two files, which a round reads from
front to back and writes anew. Between rounds one place for each string stays in memory, and the strings; in a
round the files of this part of the collection are there as well, with an order of the transform: some 20 bytes
a symbol. Who builds it divides the collection into parts for which that is little.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

END = 0


def _round(b: np.ndarray, lcp: np.ndarray, pos: np.ndarray, c: np.ndarray, nxt: np.ndarray, counts: np.ndarray, n_strings: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Insert suffixes c + (suffix at row pos), whose own preceding symbols are nxt. Returns the new transform, prefixes and rows.

    A suffix that begins with c comes after all that begin with less, in the order of the rows at which c
    stands in the transform. Its common prefix with the suffix before it is 1 more than the least common
    prefix between those two rows; the suffix after it is measured again likewise. counts has how often each
    symbol stands in the transform.
    """
    starts = np.concatenate([[0], np.cumsum(counts)])
    first = n_strings + starts - counts[0]  # row of the first suffix with each symbol from 1
    by_symbol = np.argsort(b, kind="stable")
    rank, back, ahead = np.zeros(len(pos), np.int64), np.full(len(pos), -1, np.int64), np.full(len(pos), -1, np.int64)
    order = np.argsort(c, kind="stable")
    bounds = np.flatnonzero(np.diff(c[order], prepend=-1, append=256))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        i = order[lo:hi]
        rows = by_symbol[starts[c[i[0]]] : starts[c[i[0]] + 1]]
        r = np.searchsorted(rows, pos[i])
        rank[i] = r
        back[i] = np.where(r > 0, rows[r - 1], -1)
        ahead[i] = np.where(r + 1 < len(rows), rows[np.minimum(r + 1, len(rows) - 1)], -1)
    new = first[c] + rank
    size = len(b) + len(new)
    at = np.sort(new)
    old = np.ones(size, bool)
    old[at] = False
    nb, nl = np.empty(size, np.uint8), np.empty(size, np.uint16)
    nb[old], nl[old] = b, lcp
    nb[new] = nxt
    nl[new] = 0
    for rows, lo, hi in ((new, back, pos), (new + 1, pos, ahead)):
        there = (lo >= 0) & (hi >= 0)
        if there.any():
            order = np.argsort(lo[there], kind="stable")
            a, z = lo[there][order] + 1, hi[there][order] + 1
            ends = np.minimum(z, len(lcp) - 1)
            low = np.minimum.reduceat(lcp, np.ravel(np.column_stack([a, ends])))[::2]
            low = np.where(z > ends, np.minimum(np.where(a < ends, low, 65535), lcp[-1]), low)
            nl[rows[there][order]] = low + 1
    return nb, nl, new


def build(strings: list[bytes], folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(transform, common prefixes) of the strings' suffixes in order; symbol 0 ends a string, byte x is x + 1.

    Strings are parts of UTF-8 texts, so x + 1 fits a byte. End marks are less than all symbols, in the order
    of the strings, and never equal. Row i < len(strings) is the empty suffix of string i.
    """
    d = len(strings)
    lengths = np.array([len(s) for s in strings], np.int64)
    flat = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
    ends = np.cumsum(lengths)
    with tempfile.TemporaryDirectory(dir=folder) as tmp:
        files: list[str] = []

        def put(b: np.ndarray, lcp: np.ndarray) -> None:
            """Write new files and remove the old ones, whose bytes then need never reach the disk."""
            old, files[:] = files[:], [os.path.join(tmp, f"{x}-{len(b)}") for x in ("transform", "prefixes")]
            for path, x in zip(files, (b, lcp), strict=True):
                x.tofile(path)
            for path in old:
                os.remove(path)

        def before(i: np.ndarray, j: int) -> np.ndarray:
            """The symbol before the suffix of length j of strings i."""
            inner = lengths[i] > j
            return np.where(inner, flat[np.maximum(ends[i] - j - 1, 0)] if len(flat) else END, END)

        active, pos = np.arange(d), np.arange(d)
        symbols = before(active, 0)
        put(symbols.astype(np.uint8), np.zeros(d, np.uint16))
        counts = np.bincount(symbols, minlength=256)
        for j in range(1, int(lengths.max(initial=0)) + 1):
            go = lengths[active] >= j
            active, pos, symbols = active[go], pos[go], symbols[go]
            nxt = before(active, j)
            b, lcp, pos = _round(np.fromfile(files[0], np.uint8), np.fromfile(files[1], np.uint16), pos, symbols, nxt, counts, d)
            put(b, lcp)
            counts += np.bincount(nxt, minlength=256)
            symbols = nxt
        return np.fromfile(files[0], np.uint8), np.fromfile(files[1], np.uint16)


def rows_of(strings: list[bytes], b: np.ndarray) -> list[np.ndarray]:
    """For each string the row of its suffix at each offset, found by following the transform backwards."""
    d = len(strings)
    lengths = np.array([len(s) for s in strings], np.int64)
    step = np.empty(len(b), np.int64)
    order = np.argsort(b, kind="stable")
    step[order] = np.arange(len(b))  # end marks come first, and as many as there are strings
    out = [np.zeros(n, np.int64) for n in lengths]
    active, pos = np.arange(d), np.arange(d)
    table = np.zeros((d, int(lengths.max(initial=0))), np.int64) if d else np.zeros((0, 0), np.int64)
    for j in range(1, int(lengths.max(initial=0)) + 1):
        go = lengths[active] >= j
        active, pos = active[go], pos[go]
        pos = step[pos]
        table[active, lengths[active] - j] = pos
    for i, n in enumerate(lengths):
        out[i] = table[i, :n]
    return out


def repeated(strings: list[bytes], weights: np.ndarray, window: int, folder: str | None = None) -> list[np.ndarray]:
    """For each string, which of its window starts hold a string of `window` bytes that also starts elsewhere.

    A start is repeated if its suffix shares `window` bytes with a neighbour, or if its string stands for
    several copies (weight over 1).
    """
    b, lcp = build(strings, folder)
    near = lcp >= window
    near[:-1] |= lcp[1:] >= window
    return [near[r[: max(len(s) - window + 1, 0)]] | (w > 1) for s, r, w in zip(strings, rows_of(strings, b), weights, strict=True)]
