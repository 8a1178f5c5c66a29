"""Anchors that depend on content alone: each window of bytes goes to its least k-gram hash."""

from __future__ import annotations

import numpy as np

from specloom.llm.common import hash_spans

#: Windows handled at once; also the room for a place in the low bits of a packed hash.
PIECE = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k bytes in a row; nothing where there are fewer."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    at = np.arange(len(data) - k + 1)
    return hash_spans(data, at, at + k)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width values in a row, by doubling."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(hash, digest, text, start, windows, tied) of the fragments of each text data[offsets[i]:offsets[i + 1]].

    A fragment is a run of at most window - k + 1 window starts that share the hash of their first least
    k-gram. Which hash that is depends on the window's bytes alone, so equal windows, wherever they are, lie
    in fragments of one hash. tied: some window of the fragment holds two least k-grams, without which no two
    windows of one fragment can be equal. digest is a hash of all the fragment's bytes.
    """
    width = window - k + 1
    out: list[tuple[np.ndarray, ...]] = []
    counts = np.maximum(np.diff(offsets) - window + 1, 0)
    todo = [(int(i), int(s), int(min(s + PIECE, counts[i]))) for i in np.flatnonzero(counts) for s in range(0, int(counts[i]), PIECE)]
    at = 0
    while at < len(todo):
        end, held = at, 0
        while end < len(todo) and (end == at or held + todo[end][2] - todo[end][1] + window <= PIECE):
            held += todo[end][2] - todo[end][1] + window
            end += 1
        part, at = todo[at:end], end
        texts, starts, ends = (np.array(x, np.int64) for x in zip(*part, strict=True))
        flat = np.concatenate([data[offsets[i] + s : offsets[i] + e + window - 1] for i, s, e in part])
        lengths = ends - starts + window - 1
        base = np.cumsum(lengths) - lengths
        h = gram_hashes(flat, k)
        place = np.arange(len(h), dtype=np.uint64)
        first = (_sliding_min((h & ~_PLACE) | place, width) & _PLACE).astype(np.int64)
        last = (_PLACE - (_sliding_min((h & ~_PLACE) | (_PLACE - place), width) & _PLACE)).astype(np.int64)
        n = ends - starts
        own = np.repeat(base - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))  # places of windows inside one piece
        piece = np.repeat(np.arange(len(part)), n)
        value, tied = h[first[own]], first[own] != last[own]
        new = np.ones(len(own), bool)
        new[1:] = (value[1:] != value[:-1]) | (piece[1:] != piece[:-1])
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(own)))
        pieces = -(-length // width)
        sub = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        b = np.repeat(begin, pieces) + sub * width
        size = np.minimum(width, np.repeat(begin + length, pieces) - b)
        p = piece[b]
        place = own[b]
        digest = hash_spans(flat, place, place + size + window - 1)
        out.append((value[b], digest, texts[p], starts[p] + own[b] - base[p], size, np.logical_or.reduceat(tied, b)))
    if not out:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z, z, z.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))
