"""Anchors of byte strings: the same for equal windows, wherever these stand.

Every window of WINDOW bytes is anchored at the one of its grams of GRAM bytes with the smallest
hash, the leftmost of equals. Neighbouring windows mostly share an anchor; a run of them that does is
a span. About one window in thirty-five begins a new span, so that spans, not windows, can be sent.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WINDOW, GRAM = 100, 32
WIDTH = WINDOW - GRAM + 1
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bytes hashed at a time; positions have to fit into 24 bits.
PIECE = 1 << 21


@lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Of BASE and of its inverse modulo 2**64."""
    up = np.full(PIECE + 1, BASE, np.uint64)
    down = np.full(PIECE + 1, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * MIX
    return x ^ (x >> np.uint64(29))


class Hashed:
    """Polynomial hashes of all substrings of some bytes, from prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        self.up, down = powers()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.up[start]

    def grams(self) -> np.ndarray:
        d = self.sums[GRAM:] - self.sums[:-GRAM]
        d *= self.up[: len(d)]
        return d


def spans(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of documents laid end to end, bounds[k] to bounds[k + 1] each.

    Returns document, first window start (in data), number of windows, the anchor's place after that
    start, and two hashes: of the anchor, and of all the bytes of the span's windows with its place.
    """
    n = len(data)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if n < WINDOW:
        return none
    hashed = Hashed(np.frombuffer(data, np.uint8))
    grams = mixed(hashed.grams())
    ranked = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(ranked) // WIDTH) * WIDTH, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(ranked)] = ranked
    rows = padded.reshape(-1, WIDTH)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - WINDOW + 1
    anchor = (np.minimum(back[:windows], ahead[WIDTH - 1 : WIDTH - 1 + windows]) & np.uint64(0xFFFFFF)).astype(np.int64)
    # Windows that lie in one document.
    sizes = np.diff(bounds)
    wide = sizes >= WINDOW
    inside = np.zeros(n + 1, np.int8)
    np.add.at(inside, bounds[:-1][wide], 1)
    np.add.at(inside, bounds[1:][wide] - WINDOW + 1, -1)
    inside = np.cumsum(inside[:windows], dtype=np.int8) > 0
    fresh = np.ones(windows, bool)
    fresh[1:] = anchor[1:] != anchor[:-1]
    fresh[bounds[:-1][bounds[:-1] < windows]] = True
    starts = np.flatnonzero(fresh & inside)
    if not len(starts):
        return none
    # A run ends where the next begins, or where its document's windows end.
    document = np.searchsorted(bounds, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], windows), bounds[document + 1] - WINDOW + 1)
    count = ends - starts
    at = anchor[starts]
    whole = hashed.of(starts, count + (WINDOW - 1)) * MIX + (at - starts).astype(np.uint64) * np.uint64(0x100000001B3) + count.astype(np.uint64)
    return document, starts, count, at - starts, grams[at], mixed(whole)
