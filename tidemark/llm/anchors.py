"""Anchors: places that equal windows choose alike, so that few positions stand for all windows of a text.

A text is a sequence of symbols (64-bit hashes). Its windows have `length` consecutive symbols. Each window's anchor
is the gram of `gram` symbols in it with the least hash, the leftmost of equal ones. Equal windows
have equal anchors at equal places in them; neighbouring windows mostly share one, so there are about
2 / (length - gram + 2) anchors a symbol. A row stands for the windows that share an anchor:
gram hash g, context hash c (equal if all these windows are equal and lie alike), first and last window.
Two equal windows are thus always found under one g; where both contexts are equal, all windows of one are
equal to those of the other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
BASE, MIX = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
PLACE_BITS = 21
#: Windows handled at once; long texts are cut into such slices.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(32))) * MIX
    x = (x ^ (x >> U(29))) * BASE
    return x ^ (x >> U(32))


def _power(n: int) -> np.uint64:
    return U(pow(int(BASE), n, 1 << 64))


def gram_hashes(symbols: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """Polynomial hashes of all grams of the given lengths, by joining grams of doubling lengths."""
    doubled = {1: symbols}
    n = 1
    while 2 * n <= max(lengths):
        h = doubled[n]
        doubled[2 * n] = h[:-n] * _power(n) + h[n:] if len(h) > n else h[:0]
        n *= 2
    out = []
    for length in lengths:
        have, h = 0, None
        for n in sorted(doubled, reverse=True):
            if have + n <= length:
                part = doubled[n]
                h = part if h is None else h[: max(0, len(part) - have)] * _power(n) + part[have:] if len(part) > have else h[:0]
                have += n
        out.append(h)
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values."""
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


@dataclass(frozen=True)
class Anchors:
    """One row for each anchor of a text: g, c, first and last window that share it."""

    g: np.ndarray
    c: np.ndarray
    first: np.ndarray
    last: np.ndarray


def anchors_of(symbols: np.ndarray, length: int, gram: int) -> Anchors:
    """Anchors of all windows of a text."""
    n = len(symbols) - length + 1
    if n <= 0:
        return Anchors(np.empty(0, U), np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64))
    parts = [_slice(symbols[i : min(n, i + SLICE) + length - 1], length, gram, i) for i in range(0, n, SLICE)]
    return parts[0] if len(parts) == 1 else Anchors(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("g", "c", "first", "last")))


def _slice(symbols: np.ndarray, length: int, gram: int, offset: int) -> Anchors:
    grams, windows = gram_hashes(symbols, gram, length)
    grams = mix(grams)
    low = U((1 << PLACE_BITS) - 1)
    packed = (grams & ~low) | np.arange(len(grams), dtype=U)
    least = _least(packed, length - gram + 1)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    last = np.concatenate((first[1:], [len(least)])) - 1
    place = (least[first] & low).astype(np.int64)
    g = grams[place]
    shape = (place - first).astype(U) * U(1 << 32) + (last - first).astype(U)
    c = mix(mix(windows[first] + shape) * BASE + windows[last])
    return Anchors(g, c, first + offset, last + offset)
