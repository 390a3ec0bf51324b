"""Encoded words that a worker remembers between batches."""

from __future__ import annotations

from collections.abc import Callable, Hashable

import numpy as np

Merge = Callable[[list], tuple[np.ndarray, np.ndarray]]


class _Known(dict):
    """Numbers words as they come and lists the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[Hashable] = []

    def __missing__(self, word: Hashable) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


def ordered(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in order, from parts of (places of words, ids end to end, ids of each)."""
    counts = np.zeros(words, np.int64)
    for places, _, sizes in parts:
        counts[places] = sizes
    begin = np.cumsum(counts) - counts
    flat = np.empty(int(counts.sum()), np.int64)
    for places, ids, sizes in parts:
        inner = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        flat[np.repeat(begin[places], sizes) + inner] = ids
    return flat, counts


class WordMemory:
    """Ids of texts that are lists of words, each word encoded once while it is remembered.

    ``encode`` gives the ids of a list of words end to end, and how many each has.  When
    more than ``limit`` words are known, those used once are forgotten before the next
    texts, and of the others all but the half of ``limit`` used most.
    """

    def __init__(self, encode: Merge, limit: int):
        self.encode, self.limit = encode, limit
        self.known = _Known()
        self.flat, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int64)

    def _forget(self) -> None:
        often = np.flatnonzero(self.used > 1)
        if len(often) > self.limit // 2:
            often = np.sort(often[np.argsort(-self.used[often], kind="stable")[:self.limit // 2]])
        words, known = list(self.known), _Known()
        known.update((words[i], n) for n, i in enumerate(often.tolist()))
        kept = np.zeros(len(self.counts), bool)
        kept[often] = True
        self.flat = self.flat[np.repeat(kept, self.counts)]
        self.known, self.counts, self.used = known, self.counts[often], np.zeros(len(often), np.int64)

    def ids(self, texts: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of each."""
        if len(self.known) > self.limit:
            self._forget()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        number = self.known.__getitem__
        place = np.concatenate(
            [np.zeros(0, np.int64)] + [np.fromiter(map(number, w), np.int64, len(w)) for w in texts])
        if self.known.fresh:
            flat, counts = self.encode(self.known.fresh)
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            self.counts = np.concatenate([self.counts, counts])
            self.used = np.concatenate([self.used, np.zeros(len(counts), np.int64)])
            self.known.fresh = []
        self.used += np.bincount(place, minlength=len(self.used))
        starts = np.cumsum(self.counts) - self.counts
        length = self.counts[place]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(starts[place] - (ends - length), length)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        return ids, np.diff(bounds)
