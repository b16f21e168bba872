"""Byte-pair merges in vectorised rounds over many words at once.

The symbols of all words stand in one flat array. Each round finds the smallest pair rank of each
word (a segmented minimum), merges that pair at its leftmost places that don't overlap, all words
at the same time, and compacts the arrays; words without a further pair leave. The result equals
that of merging one pair after another, best rank first, leftmost first: a merge whose product
takes part in a pair of the same or a better rank is done once per round only, so that the new pair
gets its turn, and other merges can't be overtaken.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.int32(2**31 - 1)
#: Words of more symbols are merged with a heap; rounds would take long over them.
LONG = 1024


class Merges:
    """Pairs (left, right) -> product with a rank; a smaller rank goes first."""

    def __init__(self, left, right, product, rank):
        order = np.argsort(rank, kind="stable")
        left, right, self.product, rank = (np.asarray(x, np.int64)[order] for x in (left, right, product, rank))
        self.rank = rank.astype(np.int32)
        best = np.full(int(max(left.max(), right.max(), self.product.max())) + 1, NONE, np.int64)
        np.minimum.at(best, left, rank)
        np.minimum.at(best, right, rank)
        self.once = best[self.product] <= rank
        self.product = self.product.astype(np.int32)
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(4, int(len(keys)).bit_length() + 3)
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.at = np.full(1 << self.bits, -1, np.int32)
        self.probes = 0
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.at[at[todo]] < 0
            first = todo[free][np.unique(at[todo][free], return_index=True)[1]]
            self.keys[at[first]], self.at[at[first]] = keys[first], first
            todo = np.setdiff1d(todo, first)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left, right):
        """The entry of each pair, -1 where there is none."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.at[at], np.int32(-1))
        todo = np.flatnonzero((out < 0) & (self.at[at] >= 0))
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            out[todo] = np.where(self.keys[at[todo]] == keys[todo], self.at[at[todo]], np.int32(-1))
            todo = todo[(out[todo] < 0) & (self.at[at[todo]] >= 0)]
        return out

    def ranks(self, left, right):
        entry = self.find(left, right)
        return np.where(entry < 0, NONE, self.rank[entry]), entry


def merge_long(symbols, merges: Merges) -> list[int]:
    """One word with a heap of pairs; for words of very many symbols."""
    sym, n = [int(x) for x in symbols], len(symbols)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    rank, entry = merges.ranks(np.array(sym[:-1]), np.array(sym[1:]))
    heap = [(int(r), i, int(e), sym[i], sym[i + 1]) for i, (r, e) in enumerate(zip(rank, entry, strict=True)) if e >= 0]
    heapq.heapify(heap)
    known: dict = {}

    def push(i, j):
        if (pair := (sym[i], sym[j])) not in known:
            r, e = merges.ranks(np.array([pair[0]]), np.array([pair[1]]))
            known[pair] = (int(r[0]), int(e[0]))
        r, e = known[pair]
        if e >= 0:
            heapq.heappush(heap, (r, i, e, *pair))

    while heap:
        _, i, e, a, b = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or sym[i] != a or sym[j] != b:
            continue
        sym[i], alive[j], after[i] = int(merges.product[e]), False, after[j]
        if after[i] < n:
            before[after[i]] = i
            push(i, after[i])
        if before[i] >= 0:
            push(before[i], i)
    return [s for s, live in zip(sym, alive, strict=True) if live]


def merge_words(symbols: np.ndarray, lengths: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Merges each word (of at least one symbol) until no pair remains; flat symbols and lengths."""
    lengths = np.asarray(lengths, np.int64)
    words = len(lengths)
    count, done = np.zeros(words, np.int64), []
    sym, seg = np.asarray(symbols, np.int32), np.repeat(np.arange(words), lengths)
    if (lengths > LONG).any():
        ends = np.cumsum(lengths)
        for w in np.flatnonzero(lengths > LONG):
            out = merge_long(sym[ends[w] - lengths[w] : ends[w]], merges)
            done.append((np.full(len(out), w), np.array(out, np.int32)))
        short = lengths[seg] <= LONG
        sym, seg = sym[short], seg[short]
    rank, entry = np.full(len(sym), NONE), np.full(len(sym), -1, np.int32)
    if len(sym):
        rank[:-1], entry[:-1] = merges.ranks(sym[:-1], sym[1:])
        rank[:-1][seg[1:] != seg[:-1]] = NONE
    while len(sym):
        start = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        least = np.minimum.reduceat(rank, start)
        size = np.diff(np.append(start, len(sym)))
        if (over := least == NONE).any():
            gone = np.repeat(over, size)
            done.append((seg[gone], sym[gone]))
            stay = ~gone
            sym, seg, rank, entry = sym[stay], seg[stay], rank[stay], entry[stay]
            least, size = least[~over], size[~over]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == np.repeat(least, size))
        joins = np.diff(hit) == 1  # places of one run overlap: every other one is merged
        run = np.arange(len(hit))
        head = np.concatenate([[True], ~joins])
        pick = (run - np.maximum.accumulate(np.where(head, run, 0))) % 2 == 0
        if (single := merges.once[entry[hit]]).any():
            first = np.concatenate([[True], seg[hit[1:]] != seg[hit[:-1]]])
            alone = np.zeros(words, bool)
            alone[seg[hit[single]]] = True
            pick &= first | ~alone[seg[hit]]
        hit = hit[pick]
        sym[hit] = merges.product[entry[hit]]
        stay = np.ones(len(sym), bool)
        stay[hit + 1] = False
        new = hit - np.arange(len(hit))  # where they stand after compaction
        sym, seg, rank, entry = sym[stay], seg[stay], rank[stay], entry[stay]
        # The pair that began at the removed symbol now begins at the product, and the one before ends there.
        changed = np.zeros(len(sym), bool)
        changed[new] = True
        changed[new[new > 0] - 1] = True
        look = np.flatnonzero(changed)
        tail = look[look + 1 >= len(sym)]
        rank[tail] = NONE
        look = look[look + 1 < len(sym)]
        rank[look], entry[look] = merges.ranks(sym[look], sym[look + 1])
        rank[look[seg[look] != seg[look + 1]]] = NONE
    if not done:
        return sym, count
    seg, sym = np.concatenate([a for a, _ in done]), np.concatenate([b for _, b in done])
    return sym[np.argsort(seg, kind="stable")], np.bincount(seg, minlength=words)
