"""Cuckoo filters as arrays: batches of keys are inserted, deleted and counted without a loop over keys.

A key has a fingerprint of 16 bits and two buckets of four slots, each of which follows from the other
and the fingerprint, so that entries can move without their key. A key may be inserted more than
once; deleting takes one of its entries away. A count is never below the true one: keys that share
fingerprint and buckets are counted together.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
#: Entries for each slot up to which a new table is filled, and rounds of moving after which it is too full.
LOAD, ROUNDS = 0.8, 500


class TooFull(Exception):
    pass


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that depend on all bits of x."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def rank_in_group(sorted_groups: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each run of equal values."""
    n = np.arange(len(sorted_groups))
    first = np.concatenate(([True], sorted_groups[1:] != sorted_groups[:-1])) if len(n) else np.zeros(0, bool)
    return n - np.maximum.accumulate(np.where(first, n, 0)) if len(n) else n


class Cuckoo:
    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        self.last = np.uint64(len(table) - 1)

    @classmethod
    def sized(cls, entries: int) -> Cuckoo:
        """Empty, with room for so many entries."""
        buckets = 1
        while buckets * SLOTS * LOAD < entries:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def read(cls, raw: bytes) -> Cuckoo:
        return cls(np.frombuffer(raw, "<u2").reshape(-1, SLOTS).astype(np.uint16))

    def raw(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and first bucket of 64-bit keys."""
        h = mixed(keys.astype(np.uint64))
        return ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16), (h & self.last).astype(np.int64)

    def other(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (mixed(prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & self.last).astype(np.int64)

    def insert(self, keys: np.ndarray) -> None:
        prints, bucket = self.place(keys)
        rng = np.random.default_rng(len(keys))
        for turn in range(ROUNDS):
            if not len(prints):
                return
            order = np.argsort(bucket, kind="stable")
            prints, bucket = prints[order], bucket[order]
            rank = rank_in_group(bucket)
            free = self.table[bucket] == 0
            fits = rank < free.sum(1)
            slot = (np.cumsum(free, 1) == (rank + 1)[:, None]).argmax(1)
            self.table[bucket[fits], slot[fits]] = prints[fits]
            prints, bucket, rank = prints[~fits], bucket[~fits], (rank - free.sum(1))[~fits]
            if turn:
                # The other bucket is full too: one entry of each such bucket gives way, and moves to its own other one.
                evicting = rank == 0
                b, s = bucket[evicting], rng.integers(0, SLOTS, int(evicting.sum()))
                prints[evicting], self.table[b, s] = self.table[b, s], prints[evicting]
            bucket = self.other(prints, bucket)
        raise TooFull

    def matches(self, prints: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the slots of both buckets hold the fingerprint, and the buckets."""
        other = self.other(prints, bucket)
        both = np.column_stack([bucket, other])
        found = self.table[both].reshape(len(prints), 2 * SLOTS) == prints[:, None]
        found[bucket == other, SLOTS:] = False
        return found, both

    def count(self, keys: np.ndarray) -> np.ndarray:
        return self.matches(*self.place(keys))[0].sum(1)

    def delete(self, keys: np.ndarray) -> None:
        """One entry for each key, all of which were inserted."""
        prints, bucket = self.place(keys)
        low = np.minimum(bucket, self.other(prints, bucket))
        order = np.lexsort((prints, low))
        prints, low = prints[order], low[order]
        rank = rank_in_group(low * 65536 + prints)
        found, both = self.matches(prints, low)
        slot = (np.cumsum(found, 1) == (rank + 1)[:, None]) & found
        if not slot.any(1).all():
            raise KeyError("a key that was never inserted")
        slot = slot.argmax(1)
        self.table[both[np.arange(len(slot)), slot // SLOTS], slot % SLOTS] = 0
