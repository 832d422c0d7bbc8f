"""Prefix sums that give the hash of any byte range of a text in one step."""
from __future__ import annotations

import functools

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_STIR = np.uint64(0xD6E8FEB86659FD93)


@functools.cache
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20_011).integers(0, 1 << 64, 256, dtype=np.uint64)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least `size`."""
    room = next((r for r in _POWERS if r >= size), 0)
    if not room:
        room = max(1 << 12, 1 << max(0, size - 1).bit_length())
        _POWERS.clear()
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[room] = tuple(np.cumprod(np.concatenate(
            [np.ones(1, np.uint64), np.full(room, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse))
    return _POWERS[room]


def stir(h: np.ndarray) -> np.ndarray:
    """Spreads the low bits, which a product modulo 2^64 leaves weak."""
    h = h ^ (h >> np.uint64(32))
    h = h * _STIR
    return h ^ (h >> np.uint64(29))


class RangeHash:
    """Hashes of ranges of `raw`: equal ranges have equal hashes, wherever they
    lie. 64 bits; lengths enter the hash."""

    def __init__(self, raw: bytes):
        codes = np.frombuffer(raw, np.uint8)
        self.size = len(codes)
        power, self.inverse = _powers(self.size + 1)
        self.sums = np.zeros(self.size + 1, np.uint64)
        np.cumsum(_byte_values()[codes] * power[:self.size], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return stir(h + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
