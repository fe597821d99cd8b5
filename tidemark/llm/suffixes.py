"""Sorted suffixes of many short strings at once, by prefix doubling."""

from __future__ import annotations

import numpy as np


class Suffixes:
    """Suffixes of strings of positive integers, each string ended by a 0 in `symbols`.

    sa: places in order (equal suffixes by place). room: symbols from a place to its string's end. levels: (width, ranks of the
    stretches of that width), from which common prefixes are measured.
    """

    def __init__(self, symbols: np.ndarray):
        n, bits = len(symbols), max(1, int(symbols.max(initial=0)).bit_length())
        ends = np.flatnonzero(symbols == 0)
        self.symbols, places = symbols, np.arange(n)
        self.room = ((ends[np.searchsorted(ends, places)] if n else ends) - places).astype(np.int32)
        longest = int(self.room.max()) + 1 if n else 0
        key, width = symbols.astype(np.int64), 1
        while width * 2 * bits <= 62 and width < longest:  # pack symbols without sorting
            key = (key << (width * bits)) | self._ahead(key, width)
            width *= 2
        order = np.argsort(key)
        rank, distinct = self._number(order, key[order])
        self.levels = [(width, rank.astype(np.int32))]
        place_bits = max(1, int(n).bit_length())
        while distinct < n and width < longest:
            if 3 * place_bits <= 63:  # rank, rank ahead and place fit in one number, and plain sorting is fastest
                key = np.sort(((rank << place_bits | self._ahead(rank, width)) << place_bits) | places)
                order, key = key & ((1 << place_bits) - 1), key >> place_bits
            else:
                key = rank * (distinct + 1) + self._ahead(rank, width)
                order = np.argsort(key)
                key = key[order]
            rank, distinct = self._number(order, key)
            width *= 2
            self.levels.append((width, rank.astype(np.int32)))
        del key
        self.sa = order if distinct == n or (n and 3 * place_bits <= 63 and len(self.levels) > 1) else np.argsort(rank * n + places)

    def _ahead(self, rank: np.ndarray, width: int) -> np.ndarray:
        """rank `width` places on, 0 beyond the string's end."""
        out = np.zeros_like(rank)
        out[:-width] = rank[width:]
        out *= self.room >= width
        return out

    @staticmethod
    def _number(order: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
        """Ranks from 1 by ordered keys, and how many differ."""
        numbers = np.cumsum(np.concatenate(([True], ordered[1:] != ordered[:-1])))[: len(order)]
        rank = np.empty(len(order), np.int64)
        rank[order] = numbers
        return rank, int(numbers[-1]) if len(order) else 0

    def begin_alike(self, p: np.ndarray, q: np.ndarray, least: int) -> np.ndarray:
        """Whether the suffixes at p and q agree in the widest level that `least` covers; if not, they share less than `least`."""
        coarse = [rank for width, rank in self.levels if width <= least]
        return coarse[-1][p] == coarse[-1][q] if coarse else np.ones(len(p), bool)

    def shared(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at p and q."""
        shared, room = np.zeros(len(p), np.int64), np.minimum(self.room[p], self.room[q])
        last = len(self.symbols) - 1
        for width, rank in reversed(self.levels):
            same = (shared + width <= room) & (rank[np.minimum(p + shared, last)] == rank[np.minimum(q + shared, last)])
            shared += width * same
        for _ in range(self.levels[0][0]):
            more = np.flatnonzero(shared < room)
            more = more[self.symbols[p[more] + shared[more]] == self.symbols[q[more] + shared[more]]]
            if not len(more):
                break
            shared[more] += 1
        return shared


def joined(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The strings as one array of numbers from 1, each string ended by a 0; and which string a place belongs to."""
    sizes = np.array([len(s) for s in strings], np.int64)
    owner = np.repeat(np.arange(len(strings)), sizes + 1)
    flat = np.concatenate(strings)
    if flat.dtype == np.uint8:
        numbers = np.cumsum(np.bincount(flat, minlength=256) > 0)[flat]
    else:
        numbers = np.unique(flat, return_inverse=True)[1] + 1
    symbols = np.zeros(len(flat) + len(strings), np.int32)
    symbols[np.arange(len(flat)) + np.repeat(np.arange(len(strings)), sizes)] = numbers
    return symbols, owner
