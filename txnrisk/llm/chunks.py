"""Distinct chunks of text, solved once each and kept as rows of a ragged array."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

BLOCK = 1 << 20  # characters of a long text split at a time
_RUN = re.compile("(?<![ \u2581]) ")  # the first of a run of spaces and space signs, if it is a space
Solve = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class _Numbers(dict):
    """Chunk -> row number; a chunk not seen before gets the next number and waits to be solved."""

    def __init__(self) -> None:
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self)
        self.waiting.append(chunk)
        return number


class ChunkTable:
    """Ids of chunks, remembered over texts.

    ``solve`` gets distinct chunks and returns their ids, flat, and how many each has. Beyond
    ``limit`` chunks the memory starts afresh, so a worker's memory stays bounded; results don't
    depend on it.
    """

    def __init__(self, solve: Solve, limit: int = 1_000_000, at_once: int = 50_000) -> None:
        self.solve, self.limit, self.at_once = solve, limit, at_once
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.used = 0  # of flat
        self.known = 0  # of starts and sizes

    def rows(self, blocks: Iterator[list[str]]) -> np.ndarray:
        """Row numbers of a text's chunks, in order."""
        found = []
        for chunks in blocks:
            found.append(np.fromiter(map(self.numbers.__getitem__, chunks), np.int32, len(chunks)))
        return np.concatenate(found) if found else np.zeros(0, np.int32)

    def start(self) -> None:
        """Before a batch of texts."""
        if len(self.numbers) > self.limit:
            self._clear()

    def settle(self) -> None:
        """After a batch: the rows handed out since the last call are solved."""
        waiting, self.numbers.waiting = self.numbers.waiting, []
        for at in range(0, len(waiting), self.at_once):
            ids, sizes = self.solve(waiting[at : at + self.at_once])
            self._append(ids, sizes)

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        ends = self.used + np.cumsum(sizes)
        self.starts = _room(self.starts, self.known + len(sizes))
        self.sizes = _room(self.sizes, self.known + len(sizes))
        self.flat = _room(self.flat, self.used + len(ids))
        self.starts[self.known : self.known + len(sizes)] = ends - sizes
        self.sizes[self.known : self.known + len(sizes)] = sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.known += len(sizes)
        self.used += len(ids)

    def ids(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the given rows, one after another."""
        sizes = self.sizes[rows]
        total = int(sizes.sum())
        shift = self.starts[rows] - (np.cumsum(sizes) - sizes)
        return self.flat[np.repeat(shift, sizes) + np.arange(total)]


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    return np.concatenate((array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)))


def blocks_of(text: str, size: int = BLOCK) -> Iterator[str]:
    """A text in blocks that end right before a run of spaces, whose first one is left out; only its
    last block may lack the cut."""
    at = 0
    while len(text) - at > size:
        found = _RUN.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:] if at else text
