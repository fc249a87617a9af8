"""Sets of hashed word shingles of whole texts, in a few array operations a text.

Words are runs of bytes other than the six ASCII white-space bytes, with A-Z lower-cased. A word's
hash is a polynomial over its bytes modulo 2**64, taken from running sums; a shingle's hash chains
its words' hashes. Two different shingles of a pair of texts share a 64-bit hash with odds of about
n**2 / 2**64.
"""

from __future__ import annotations

import numpy as np

_M = np.uint64(0x9E3779B97F4A7C15)
_C = np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE = np.random.default_rng(5).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, up to n."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        inverse = np.uint64(pow(int(_M), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, m, np.uint64)]), dtype=np.uint64) for m in (_M, inverse)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each bit over the whole number."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """The hash of each word, in order."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z alone
    b = np.frombuffer(raw, np.uint8)
    space = np.empty(len(b) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = _SPACE[b]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _C)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Distinct shingle hashes, ascending; fewer words than ``size`` are one shingle; no words, none."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(size, len(w))
    h = w[: len(w) - k + 1].copy() + np.uint64(k)
    for j in range(1, k):
        h = mix(h * _C + w[j : len(w) - k + 1 + j])
    return np.unique(h)
