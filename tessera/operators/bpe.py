"""The state of byte-pair training on one shard of pieces, and its codec.

A shard keeps the tokens of its pieces end to end with links to the neighbours
and an inverted index from each adjacent pair to its places, so a merge touches
the places of its pair and nothing else, and says by how much the counts of
which pairs changed. Before any merge it is stored as the bytes of its pieces,
their sizes and counts, from which links and index are quickly made.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterable

import numpy as np

#: Pair (a, b) as one number; token ids stay below.
TOKENS = 1 << 24


class PieceShard:
    """``pieces`` (UTF-8) with their counts, as single bytes at first."""

    def __init__(self, pieces: Iterable[bytes], counts: Iterable[int]):
        pieces = list(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        self._link(b"".join(pieces), sizes, np.fromiter(counts, np.int64, len(pieces)))

    def _link(self, data: bytes, sizes: np.ndarray, counts: np.ndarray) -> None:
        self.raw = data, sizes, counts
        n = int(sizes.sum())
        self.tok = np.frombuffer(data, np.uint8).astype(np.int32)
        self.weight = np.repeat(counts, sizes)
        ends = np.cumsum(sizes)[sizes > 0]
        self.nxt, self.prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        self.nxt[ends - 1] = -1
        self.prv[np.concatenate(([0], ends[:-1])) if n else []] = -1
        at = np.flatnonzero(self.nxt >= 0)
        # two bytes a pair: numpy sorts these by radix
        codes = (self.tok[at] * 256 + self.tok[self.nxt[at]]).astype(np.uint16)
        order = np.argsort(codes, kind="stable")
        self.places = at[order]
        codes = codes[order]
        self.starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
        first = codes[self.starts].astype(np.int64)
        self.pairs = first // 256 * TOKENS + first % 256
        self.fresh: dict[int, list[np.ndarray]] = {}

    def codes(self, at: np.ndarray) -> np.ndarray:
        return self.tok[at].astype(np.int64) * TOKENS + self.tok[self.nxt[at]]

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs and their counts, before any merge."""
        sums = np.add.reduceat(self.weight[self.places], self.starts) if len(self.pairs) else np.zeros(0, np.int64)
        return self.pairs, sums

    def _find(self, a: int, b: int) -> np.ndarray:
        """Places where b follows a, ascending."""
        code = a * TOKENS + b
        found = self.fresh.pop(code, [])
        k = int(np.searchsorted(self.pairs, code))
        if k < len(self.pairs) and self.pairs[k] == code:
            first = self.places[self.starts[k] : self.starts[k + 1] if k + 1 < len(self.starts) else None]
            at = np.unique(np.concatenate((first, *found))) if found else first
        else:
            at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        at = at[(self.tok[at] == a) & (self.nxt[at] >= 0)]
        return at[self.tok[self.nxt[at]] == b]

    def merge(self, a: int, b: int, new: int) -> tuple[np.ndarray, np.ndarray]:
        """Replace (a, b) by ``new`` left to right, without overlaps: the pairs
        whose counts changed, and by how much."""
        self.raw = None
        p = self._find(a, b)
        if a == b and len(p):  # of a run of overlapping places every other one counts
            first = np.ones(len(p), bool)
            first[1:] = self.nxt[p[:-1]] != p[1:]
            run = np.maximum.accumulate(np.where(first, np.arange(len(p)), 0))
            p = p[(np.arange(len(p)) - run) % 2 == 0]
        q = self.nxt[p]
        y, x = self.nxt[q], self.prv[p]
        # places don't overlap, so of all these only an x can be the q before it
        gone = np.concatenate((x[(x >= 0) & (x != np.append(-1, q[:-1])[: len(q)])], p, q[y >= 0]))
        old, lost = self.codes(gone), self.weight[gone]
        self.tok[p], self.tok[q], self.nxt[p] = new, -1, y
        self.prv[y[y >= 0]] = p[y >= 0]
        x = self.prv[p]
        made = np.concatenate((x[(x >= 0) & (x != np.append(-1, p[:-1])[: len(p)])], p[y >= 0]))
        codes = self.codes(made)
        order = np.argsort(codes, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
            if len(part):
                self.fresh.setdefault(int(codes[part[0]]), []).append(made[part])
        every, by = np.concatenate((old, codes)), np.concatenate((-lost, self.weight[made]))
        order = np.argsort(every, kind="stable")
        every = every[order]
        starts = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
        pairs, change = every[starts], np.add.reduceat(by[order], starts) if len(every) else by
        return pairs[change != 0], change[change != 0]

    def dump(self) -> bytes:
        return pickle.dumps(self if self.raw is None else self.raw, 5)

    @staticmethod
    def load(data: bytes) -> PieceShard:
        got = pickle.loads(data)
        if isinstance(got, PieceShard):
            return got
        shard = PieceShard.__new__(PieceShard)
        shard._link(*got)
        return shard


def pair(code: int) -> tuple[int, int]:
    return divmod(int(code), TOKENS)


def best_pair(counts: dict[int, float]) -> int | None:
    """The pair with the highest count, the least (left, right) among equals."""
    return min(counts, key=lambda c: (-counts[c], c), default=None)


def predict(sample: PieceShard, counts: dict[int, int], first: int, steps: int) -> list[tuple[int, int, int]]:
    """Likely next merges (left, right, new id): training goes on over the
    sample alone, whose changes are scaled to the counts of all pieces."""
    guess, out = dict(counts), []
    for new in range(first, first + steps):
        code = best_pair(guess)
        if code is None or guess[code] <= 0:
            break
        a, b = pair(code)
        out.append((a, b, new))
        pairs, change = sample.merge(a, b, new)
        scale = 1.0
        for c, d in zip(pairs.tolist(), change.tolist()):
            if c == code and d < 0:
                scale = max(1.0, guess[code] / -d)
        for c, d in zip(pairs.tolist(), change.tolist()):
            if c in guess or d > 0:
                guess[c] = guess.get(c, 0) + d * scale
        guess.pop(code, None)
    return out


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge adjacent parts, the lowest rank first and the leftmost of equals, by
    a heap over a doubly linked list of parts: n log n in the piece's length."""
    n = len(piece)
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    get, end, prv = ranks.get, list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        # the left part still starts at i, and its neighbour still ends at e
        mid = end[i]
        if mid < 0 or mid >= n or end[mid] != e:
            continue
        end[i], end[mid] = e, -1
        if e < n:
            prv[e] = i
            if (r := get(piece[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        if (h := prv[i]) >= 0 and (r := get(piece[h:e])) is not None:
            heapq.heappush(heap, (r, h, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class PieceMerger:
    """``encode_piece`` over many pieces at a time: short ones lie in the rows of a
    table of tokens, and a step does the next merge of every row, the lowest rank
    first and the leftmost of equals. Long pieces go to ``encode_piece``. There is
    no table for vocabularies too large for one of all pairs, or with tokens that
    no merges make."""

    #: Bytes of a short piece, and the most tokens.
    WIDTHS, TOKENS = (4, 8, 16, 32), 2048

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.table = ranks, None
        tokens = sorted(ranks, key=ranks.__getitem__)
        at = {t: i for i, t in enumerate(tokens)}
        if len(tokens) >= self.TOKENS or any(bytes([b]) not in at for b in range(256)):
            return
        # a row's end is a token without pairs; no pair: that token too
        self.end = len(tokens)
        self.bytes = np.array([at[bytes([b])] for b in range(256)], np.int32)
        self.ids = np.array([ranks[t] for t in tokens], "<i4")
        self.table = np.full((self.end + 1, self.end + 1), self.end, np.int32)
        for t, i in at.items():
            for k in range(1, len(t)):
                if t[:k] in at and t[k:] in at:
                    self.table[at[t[:k]], at[t[k:]]] = i
        some = [t for t in tokens if len(t) <= self.WIDTHS[-1]]
        ids, counts = self.encode(np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some[:-1])]))
        if (counts != 1).any() or ids.tolist() != [ranks[t] for t in some]:
            self.table = None

    def _block(self, data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of rows of bytes, and which places hold one."""
        cols = np.arange(data.shape[1])
        done = np.where(inside, self.bytes[data], self.end)
        rows, tok = np.arange(len(done)), done.copy()
        while len(rows):
            rank = self.table[tok[:, :-1], tok[:, 1:]]
            at = rank.argmin(1)
            best = rank[np.arange(len(at)), at]
            more = best < self.end
            done[rows[~more]] = tok[~more]
            rows, tok, at, best = rows[more], tok[more], at[more], best[more]
            moved = np.append(tok[:, 1:], np.full((len(tok), 1), self.end, np.int32), 1)
            tok = np.where(cols > at[:, None], moved, tok)
            tok[np.arange(len(at)), at] = best
        return done, done < self.end

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pieces that start there, end to end: all ids, and how many each has."""
        sizes = np.diff(np.append(starts, len(data)))
        group = np.searchsorted(self.WIDTHS, sizes)
        counts, got = np.zeros(len(starts), np.int64), []
        for g, width in enumerate(self.WIDTHS):
            where, cols = np.flatnonzero(group == g), np.arange(width)
            for k in range(0, len(where), 4096):  # tables of a block stay in the processor's cache
                some = where[k : k + 4096]
                at = np.minimum(starts[some][:, None] + cols, len(data) - 1)
                done, kept = self._block(data[at], cols < sizes[some][:, None])
                counts[some] = kept.sum(1)
                got.append((some, done, kept))
        for i in np.flatnonzero(group == len(self.WIDTHS)).tolist():
            ids = np.array([encode_piece(data[starts[i] : starts[i] + sizes[i]].tobytes(), self.ranks)], "<i4")
            counts[i] = ids.size
            got.append((np.array([i]), ids, None))
        out = np.empty(counts.sum(), "<i4")
        first = np.cumsum(counts) - counts
        for some, done, kept in got:
            if kept is None:
                out[first[some[0]] : first[some[0]] + done.size] = done[0]
            else:
                out[(first[some][:, None] + np.cumsum(kept, 1) - 1)[kept]] = self.ids[done[kept]]
        return out, counts
