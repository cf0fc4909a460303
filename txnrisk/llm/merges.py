"""Byte-pair merging of many short sequences at once, on ragged arrays."""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.int64(1) << 30  # rank of a pair that doesn't merge
LONG = 400  # symbols; longer sequences are merged one by one with a heap


class Pairs:
    """Which pairs of symbols merge, into what, and in which order (lowest rank first)."""

    def __init__(self, left, right, rank, merged, symbols: int) -> None:
        keys = np.asarray(left, np.int64) * symbols + np.asarray(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.symbols = symbols
        self.keys = keys[order]
        self.rank = np.asarray(rank, np.int64)[order]
        self.merged = np.asarray(merged, np.int64)[order]
        self._single: dict[int, tuple[int, int]] | None = None

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and merged symbols of pairs; NONE and 0 where a pair doesn't merge."""
        wanted = left * self.symbols + right
        if not len(self.keys):
            return np.full(len(wanted), NONE), np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = self.keys[at] == wanted
        return np.where(hit, self.rank[at], NONE), np.where(hit, self.merged[at], 0)

    def single(self) -> dict[int, tuple[int, int]]:
        if self._single is None:
            self._single = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.merged.tolist())))
        return self._single


def merge_all(symbols: np.ndarray, sizes: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Sequences (flat symbols, sizes) after all merges, flat symbols and sizes again.

    In every round each sequence merges the leftmost of its lowest-rank pairs, all sequences at once;
    that is the order in which a queue of pairs would merge a sequence, so results are exact for any
    ranks. Sequences without a further merge leave the arrays.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    symbols = symbols.astype(np.int64)
    done_owner, done_symbols = [], []
    long = sizes > LONG
    if long.any():  # split off once, each long sequence read by its own offsets
        starts = np.cumsum(sizes) - sizes
        for i in np.flatnonzero(long).tolist():
            left = merge_long(symbols[starts[i] : starts[i] + sizes[i]].tolist(), pairs)
            done_owner.append(np.full(len(left), i))
            done_symbols.append(np.asarray(left, np.int64))
        short = np.repeat(~long, sizes)
        symbols, owner = symbols[short], owner[short]
    rank, merged = _ranked(symbols, owner, np.arange(len(symbols)), pairs)
    while len(symbols):
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        best = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), first)
        going = best < (NONE << 32)
        at = best[going] & 0xFFFFFFFF
        keep = np.ones(len(symbols), bool)
        if not going.all():
            keep = np.repeat(going, np.diff(np.append(first, len(symbols))))
            done_owner.append(owner[~keep])
            done_symbols.append(symbols[~keep])
        symbols[at] = merged[at]
        keep[at + 1] = False
        now = np.cumsum(keep)[at] - 1
        symbols, owner, rank, merged = symbols[keep], owner[keep], rank[keep], merged[keep]
        changed = np.concatenate((now, now[now > 0] - 1))
        rank[changed], merged[changed] = _ranked(symbols, owner, changed, pairs)
    owner = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
    flat = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    return flat[order], np.bincount(owner, minlength=len(sizes)).astype(np.int64)


def _ranked(symbols, owner, at, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Rank and outcome of the pairs that begin at the given places."""
    rank = np.full(len(at), NONE)
    merged = np.zeros(len(at), np.int64)
    inner = at + 1 < len(symbols)
    inner[inner] = owner[at[inner]] == owner[at[inner] + 1]
    here = at[inner]
    rank[inner], merged[inner] = pairs.look_up(symbols[here], symbols[here + 1])
    return rank, merged


def merge_long(symbols: list[int], pairs: Pairs) -> list[int]:
    """The same merges on one long sequence, in time n log n."""
    known, base = pairs.single(), pairs.symbols
    after = list(range(1, len(symbols) + 1))
    before = list(range(-1, len(symbols) - 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(symbols) and (found := known.get(symbols[i] * base + symbols[j])):
            heapq.heappush(heap, (found[0], i, symbols[i], symbols[j], found[1]))

    for i in range(len(symbols) - 1):
        offer(i)
    while heap:
        _, i, left, right, new = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= len(symbols) or symbols[j] != right:
            continue
        symbols[i], symbols[j] = new, -1
        after[i] = after[j]
        if after[j] < len(symbols):
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [s for s in symbols if s >= 0]
