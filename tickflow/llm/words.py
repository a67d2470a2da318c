"""Words of many texts at once: their bounds and 64-bit hashes by array operations.

A word is a run of ``[^\\x20\\x09-\\x0D]``; UTF-8 keeps its bytes apart from those
of the separators, so bytes are enough.  Texts are laid end to end with a space
after each.  A word's hash is a polynomial in its bytes modulo 2**64, taken from
one running sum, then scrambled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Powers are held for texts of up to so many bytes, made anew for longer ones, and go with the worker's small memory.
_HELD = 1 << 19


def _ladder(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64))])


@lru_cache(maxsize=2)
def _held(base: int) -> np.ndarray:
    return _ladder(np.uint64(base), _HELD)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of ``base``."""
    return _held(int(base))[:n] if n <= _HELD else _ladder(base, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Texts:
    """``data``: the bytes with a space after each text; ``bounds``: where each text starts, and the end."""

    data: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, texts: list[str | bytes | None], lower: bool = False) -> Texts:
        raw = [t if isinstance(t, bytes) else (t or "").encode() for t in texts]
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
        return cls(_LOWER[data] if lower else data, bounds)

    def lowered(self) -> Texts:
        return Texts(_LOWER[self.data], self.bounds)

    def sums(self) -> np.ndarray:
        """Running sums of the bytes (plus one) times powers of the base; one more than bytes."""
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(self.data)), out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        inverse = _powers(_INVERSE, len(self.data) + 1)
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the text that each belongs to."""
        inside = ~SPACE[self.data]
        edge = np.diff(np.concatenate([[0], inside.view(np.int8)]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        owner = np.searchsorted(self.bounds, starts, side="right") - 1
        return starts, ends, owner


def grams(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows that stay in a text, and where each starts in ``hashes``."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(hashes) - n + 1
    out = hashes[:size]
    for k in range(1, n):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + hashes[k : k + size])
    at = np.flatnonzero(owner[:size] == owner[n - 1 :])
    return out[at], at
