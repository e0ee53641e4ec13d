"""Seeded hashing: the deterministic stand-in for every random draw.

``h(seed, *cols)`` is the first 8 hex digits of ``md5("seed:c1:c2…")`` read as
a non-negative long. The same expression is available in DuckDB, so results
that depend on a draw can be checked in SQL.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def h(seed, *cols) -> Column:
    parts = [F.lit(str(seed))] + [_col(c).cast("string") for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint")


def u_of(x) -> Column:
    """Uniform draw in [0, 1) from an already-built key string."""
    return F.conv(F.substring(F.md5(_col(x).cast("string")), 1, 8), 16, 10).cast("bigint") / F.lit(TWO32)


def u(seed, *cols) -> Column:
    return h(seed, *cols) / F.lit(TWO32)


# RFC 1321: constants, places of the sixteen words, and rotations of the 64 steps.
_K = [int(abs(np.sin(i + 1)) * TWO32) & 0xFFFFFFFF for i in range(64)]
_WORD = [i for i in range(16)] + [(5 * i + 1) % 16 for i in range(16)] + [(3 * i + 5) % 16 for i in range(16)] + [7 * i % 16 for i in range(16)]
_TURN = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
#: Draws made at a time: the arrays of a step stay in the processor's cache.
_DRAWS = 1 << 14


def _heads(words: list) -> np.ndarray:
    """First 32 bits, as in the hex digest, of the md5 of one-block messages: each
    of the sixteen words is an array over messages, or one number for all."""
    a, b, c, d = (np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    with np.errstate(over="ignore"):
        for i in range(61):  # the last three steps don't change this part
            if i < 16:
                f = ((c ^ d) & b) ^ d
            elif i < 32:
                f = ((b ^ c) & d) ^ c
            elif i < 48:
                f = b ^ c ^ d
            else:
                f = c ^ (b | ~d)
            w = words[_WORD[i]]
            f = f + (a + np.uint32(_K[i])) + w if isinstance(w, np.ndarray) else f + (a + np.uint32((_K[i] + w) & 0xFFFFFFFF))
            t = np.uint32(_TURN[i])
            a, d, c, b = d, c, b, b + ((f << t) | (f >> (np.uint32(32) - t)))
        return (b + np.uint32(0x67452301)).byteswap()


def heads_up_to(prefixes: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """For each prefix the first 32 bits of the md5 of ``prefix + str(p)`` for p
    from 0 to its count: what ``h`` draws, for many p at a time."""
    out = [np.empty(n, np.uint32) for n in counts]
    groups: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for k, (prefix, n) in enumerate(zip(prefixes, counts)):
        low, digits = 0, 1
        while low < n:
            groups.setdefault((len(prefix), digits), []).append((k, low, min(n, 10**digits)))
            low, digits = 10**digits, digits + 1
    for (size, digits), some in groups.items():
        if size + digits > 55:  # more than one block
            for k, low, high in some:
                out[k][low:high] = [int(hashlib.md5(prefixes[k] + b"%d" % p).hexdigest()[:8], 16) for p in range(low, high)]
            continue
        ranges = [(k, a, min(a + _DRAWS, high)) for k, low, high in some for a in range(low, high, _DRAWS)]
        at = 0
        while at < len(ranges):
            end, total = at, 0
            while end < len(ranges) and (end == at or total + ranges[end][2] - ranges[end][1] <= _DRAWS):
                total += ranges[end][2] - ranges[end][1]
                end += 1
            block, at = ranges[at:end], end
            sizes = [b - a for _, a, b in block]
            heads = np.array([np.frombuffer(prefixes[k].ljust(64, b"\0"), "<u4") for k, _, _ in block])
            words: list = [np.repeat(heads[:, j], sizes) if j * 4 < size else 0 for j in range(16)]
            left = np.concatenate([np.arange(a, b, dtype=np.uint32) for _, a, b in block])
            signs = []
            for _ in range(digits):
                left, sign = np.divmod(left, np.uint32(10))
                signs.append(sign + np.uint32(48))
            for j, sign in enumerate([*signs[::-1], np.uint32(0x80)]):
                w, shift = divmod(size + j, 4)
                words[w] = words[w] | (sign << np.uint32(8 * shift))
            words[14] = 8 * (size + digits)
            got, start = _heads([w if isinstance(w, np.ndarray) else int(w) for w in words]), 0
            for (k, a, b), n in zip(block, sizes):
                out[k][a:b] = got[start : start + n]
                start += n
    return out
