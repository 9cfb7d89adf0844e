"""Hashes of byte windows, and anchors that equal windows share.

Every window of ``size`` bytes is represented by its *anchor*: of the grams of
``gram`` bytes inside it the one with the least hash, the leftmost if several
have it. Equal windows have equal anchors at equal places, whatever stands
around them, so equality of windows can be decided among windows of one gram.
"""

from __future__ import annotations

import functools

import numpy as np

from .common import mix64, powers

#: Bases of the polynomial hashes: of the usual one, and of another beside it.
BASES = (0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03 | 1)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
#: Bits of a key that hold a gram's place; longer pieces are keyed in parts.
PLACE = np.uint64((1 << 23) - 1)


@functools.cache
def _byte_codes() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)


class Hashes:
    """Polynomial hashes of any byte range of one array."""

    def __init__(self, data: np.ndarray, kind: int = 0):
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(_byte_codes()[data] * powers(BASES[kind], len(data)), out=self.sums[1:])
        self.back = powers(INVERSES[kind], len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for arrays of places."""
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.back[start])

    def all_of(self, size: int) -> np.ndarray:
        """Hash of every range of ``size`` bytes."""
        with np.errstate(over="ignore"):
            n = len(self.sums) - size
            return mix64((self.sums[size:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.empty(0, dtype=np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours."""
    n = len(x) - width + 1
    if n <= 0:
        return np.empty(0, dtype=x.dtype)
    full = -(-len(x) // width) * width
    blocks = np.full(full, np.iinfo(x.dtype).max, dtype=x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def least_places(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the gram of least hash, leftmost if several, of each ``width`` neighbours.

    Places inside a part fit ``PLACE``; neighbouring parts overlap, so that
    each run of neighbours is whole in one.
    """
    step = int(PLACE) + 2 - width
    if step < 1:
        raise ValueError(f"windows of more than {int(PLACE) + 1} grams")
    parts = [np.empty(0, dtype=np.int64)]
    for at in range(0, len(grams) - width + 1, step):
        part = grams[at : at + step + width - 1]
        keys = (part & ~PLACE) | np.arange(len(part), dtype=np.uint64)
        parts.append((sliding_min(keys, width) & PLACE).astype(np.int64) + at)
    return np.concatenate(parts)


def anchors(data: np.ndarray, bounds: np.ndarray, size: int, gram: int) -> dict[str, np.ndarray]:
    """Anchors of all windows of the texts data[bounds[i]:bounds[i + 1]].

    ``text`` is the text's number; ``place``, ``first`` and ``last`` are places
    in ``data``: the gram's begin and the first and last window it represents
    there. ``gram`` is the gram's hash, ``around`` that of the bytes of all
    these windows together.
    """
    h = Hashes(data)
    grams = h.all_of(gram)
    least = least_places(grams, size - gram + 1)
    start = np.arange(len(least))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(least)]
    inside = start + size <= bounds[1:][text] if len(least) else np.empty(0, dtype=bool)
    start, text = start[inside], text[inside]
    place = least[inside]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    first = start[at]
    last = start[np.append(at[1:], len(start))[: len(at)] - 1] if len(at) else first
    place, text = place[at], text[at]
    with np.errstate(over="ignore"):
        shape = mix64((place - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64) + np.uint64(1))
    return {"text": text, "place": place, "first": first, "last": last, "gram": grams[place], "around": mix64(h.of(first, last + size) ^ shape)}
