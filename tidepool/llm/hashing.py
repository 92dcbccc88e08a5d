"""Vectorised 64-bit hashes of words and of windows of words, for use inside tasks."""

from __future__ import annotations

from functools import cache

import numpy as np

_U = np.uint64
#: Odd multipliers, one per independent hash.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SLICE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (kept in sizes of powers of two)."""
    size = 1 << max(10, (n - 1).bit_length())
    return (_powers(base, size) if size <= 1 << 21 else np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, base, _U)]), dtype=_U))[:n]


class Words:
    """The words of a list of UTF-8 texts: ``bounds[i]:bounds[i+1]`` are those of text i; ``hashes(k)`` is one hash each."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        space = _SPACE[data]
        self.starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        self.lengths = ends - self.starts
        offsets = np.cumsum([1, *(len(t) + 1 for t in texts)])
        self.bounds = np.searchsorted(self.starts, offsets)
        self._letters = data[~space]
        self._at = np.concatenate([[0], np.cumsum(self.lengths)])

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, k: int = 0) -> np.ndarray:
        out, n = np.empty(len(self), _U), len(self)
        longest = int(self.lengths.max()) if n else 0
        table, i = powers(BASES[k], max(longest, 1)), 0
        while i < n:  # slices of bounded size
            j = max(i + 1, int(np.searchsorted(self._at, self._at[i] + _SLICE, "right")) - 1)
            a, b = self._at[i], self._at[j]
            within = np.arange(b - a) - np.repeat(self._at[i:j] - a, self.lengths[i:j])
            out[i:j] = np.add.reduceat((self._letters[a:b].astype(_U) + _U(1)) * table[within], self._at[i:j] - a)
            i = j
        return mix(out + self.lengths.astype(_U) * _U(BASES[1 - k]))

    def windows(self, hashes: np.ndarray, size: int, k: int = 0) -> np.ndarray:
        """The hash of ``size`` words from each word on (of no meaning where the text ends before)."""
        n = len(hashes)
        if n < size:
            return np.zeros(n, _U)
        base = BASES[k] | 1
        s = np.concatenate([[_U(0)], np.cumsum(hashes * powers(base, n), dtype=_U)])
        out = np.zeros(n, _U)
        out[: n - size + 1] = mix((s[size:] - s[: n - size + 1]) * powers(pow(base, -1, 1 << 64), n)[: n - size + 1])
        return out

    def inside(self, size: int) -> np.ndarray:
        """Where a window of that many words still lies in its text."""
        ends = np.repeat(self.bounds[1:], np.diff(self.bounds))
        return np.arange(len(self)) + size <= ends
