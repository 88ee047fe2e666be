"""Minimal perfect hashes of byte strings, in shards, with their keys stored for verification.

The keys of a shard are thrown into a row of bits about twice as long as there are keys. Keys that
fall alone set their bit; the others are thrown again, into a shorter row under another hash, until
none is left. A key's slot is the number of bits set before its own, so the slots of ``n`` keys are
0 to ``n - 1``. A string that is no key may land on a set bit as well: the key stored for the slot tells.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Bits of a row for each key thrown into it.
GAMMA = 2
#: Rows after which keys that still collide are listed instead (two keys with one 128-bit hash).
MOST_ROWS = 64

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def hashed(keys: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each string."""
    raw = b"".join(xxhash.xxh3_128_digest(k) for k in keys)
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes[:, 0] % np.uint64(shards)).astype(np.int64)


def _place(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    x = hashes[:, 0] ^ (hashes[:, 1] + np.uint64(row + 1) * _MIX[0])
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return ((x ^ (x >> np.uint64(31))) % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """The hash of one shard's different keys. ``slots`` of other strings are -1."""

    def __init__(self, keys: list[bytes]):
        left = np.arange(len(keys))
        hashes = hashed(keys)
        self.rows: list[int] = []
        marks = []
        while len(left) and len(self.rows) < MOST_ROWS:
            bits = max(8, GAMMA * len(left))
            at = _place(hashes[left], len(self.rows), bits)
            alone = np.bincount(at, minlength=bits) == 1
            marks.append(alone)
            self.rows.append(bits)
            left = left[~alone[at]]
        set_bits = np.concatenate(marks) if marks else np.zeros(0, bool)
        self.first = np.cumsum([0, *self.rows])[:-1]
        self.bits = np.packbits(set_bits, bitorder="little")
        # Set bits before each block of 64; the rest is counted when asked.
        padded = np.concatenate([self.bits, np.zeros(-len(self.bits) % 8 + 8, np.uint8)])
        self.words = padded.view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words))[:-1]].astype(np.int64)
        self.listed = {keys[k]: len(keys) - len(left) + n for n, k in enumerate(left.tolist())}
        self.keys: list[bytes] = [b""] * len(keys)
        for key, slot in zip(keys, self._slots(keys, hashes).tolist()):
            self.keys[slot] = key

    def __len__(self) -> int:
        return len(self.keys)

    def _slots(self, keys: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """The slots of keys; of other strings a slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for row, (bits, first) in enumerate(zip(self.rows, self.first)):
            if not len(left):
                break
            at = first + _place(hashes[left], row, bits)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.before[at >> 6] + below)[hit]
            left = left[~hit]
        for k in left.tolist() if self.listed else ():
            out[k] = self.listed.get(keys[k], -1)
        return out

    def slots(self, strings: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """The slot of each string, -1 for those that are no key."""
        found = self._slots(strings, hashes)
        sure = [s >= 0 and self.keys[s] == x for s, x in zip(found.tolist(), strings)]
        return np.where(sure, found, -1)
