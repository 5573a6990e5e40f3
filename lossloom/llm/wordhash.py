"""Vectorised word hashing: every word of many texts in a few numpy passes, with no Python work per word."""

from __future__ import annotations

import numpy as np

#: Space and the control characters tab, line feed, vertical tab, form feed, carriage return.
SPACE = bytes([9, 10, 11, 12, 13, 32])
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cases A-Z; all that is neither digit, letter nor above ASCII becomes a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, grown by doubling."""
    p = _POWERS.get(base)
    if p is None or len(p) < n:
        p = np.ones(1, np.uint64)
        while len(p) < n:
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
        _POWERS[base] = p
    return p[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit (wraps mod 2**64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the space-separated words of each text, and the n+1 offsets of the texts' first words.

    ``raw`` is already lower-cased as wanted; a word never crosses a text boundary.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    b = np.frombuffer(raw, np.uint8)
    inside = ~_IS_SPACE[b]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[b] * _powers(_BASE, n), out=total[1:])
    return mix((total[end] - total[start]) * _powers(_INV, n)[start]), np.searchsorted(start, offsets)
