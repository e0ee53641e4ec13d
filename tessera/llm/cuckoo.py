"""A cuckoo filter: a set of 64-bit hashes kept as 16-bit fingerprints in
buckets of four, with lookups, insertions and deletions. A fingerprint and one
of its two buckets fix the other, so keys that share both are exchangeable and
deletions never touch another key. A filter that is full must be built anew from
the keys: fingerprints alone don't tell where they belong in a larger one."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

SLOTS, KICKS = 4, 200
_MIX = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


class CuckooFilter:
    """No false negative; a false positive at a rate of about 8 / 2**16.
    Insert a key once, and delete only keys that were inserted."""

    def __init__(self, expected: int = 0, slots: bytes | None = None):
        n = len(slots) // 2 // SLOTS if slots else 1 << max(4, int(np.ceil(np.log2(max(1, expected) / (0.9 * SLOTS) + 1))))
        self.mask = n - 1
        self.slot = np.frombuffer(slots, "<u2").tolist() if slots else [0] * (n * SLOTS)

    @classmethod
    def build(cls, hashes: Iterable[int], expected: int) -> CuckooFilter:
        """A filter of the distinct ``hashes``, as large as it must be."""
        hashes = list(hashes)
        while True:
            f = cls(expected)
            if all(f.insert(h) for h in hashes):
                return f
            expected = 2 * SLOTS * (f.mask + 1)

    def _place(self, h: int) -> tuple[int, int, int]:
        fp = (h >> 48 & 0xFFFF) or 1
        i = h & self.mask
        return fp, i, self._other(fp, i)

    def _other(self, fp: int, i: int) -> int:
        return i ^ (((fp * _MIX & _ALL) >> 20) & self.mask)

    def _put(self, fp: int, i: int) -> bool:
        s = self.slot
        for j in range(i * SLOTS, i * SLOTS + SLOTS):
            if not s[j]:
                s[j] = fp
                return True
        return False

    def insert(self, h: int) -> bool:
        """False, with the filter as it was, if there is no room."""
        fp, i, at = self._place(h)
        if self._put(fp, i) or self._put(fp, at):
            return True
        s, moved = self.slot, []
        for n in range(KICKS):
            j = at * SLOTS + n % SLOTS
            moved.append((j, s[j]))
            fp, s[j] = s[j], fp
            at = self._other(fp, at)
            if self._put(fp, at):
                return True
        for j, old in reversed(moved):
            s[j] = old
        return False

    def _find(self, h: int) -> int:
        fp, i, k = self._place(h)
        for b in (i, k):
            for j in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.slot[j] == fp:
                    return j
        return -1

    def __contains__(self, h: int) -> bool:
        return self._find(h) >= 0

    def delete(self, h: int) -> bool:
        j = self._find(h)
        if j >= 0:
            self.slot[j] = 0
        return j >= 0

    def dump(self) -> bytes:
        return np.array(self.slot, "<u2").tobytes()
