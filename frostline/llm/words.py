"""Words and word-window hashes of many texts at once, on arrays of bytes."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)  # a random value for each byte
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = _U(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words of letters, digits and everything beyond ASCII, after lower-casing.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def spans(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text (n + 1 entries) the number of words before it."""
    inside = word_bytes[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts], after[cuts - 1] = False, False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums s and factors f so that (s[b] - s[a]) * f[a] depends on the bytes a to b alone."""
    global _powers
    if len(_powers[0]) < len(data) + 1:
        size = max(len(data) + 1, 1 << 20)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers[0][: len(data)], out=sums[1:])
    return sums, _powers[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    sums, down = prefix_sums(data)
    return mix((sums[ends] - sums[starts]) * down[starts])


def windows(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `size` words inside a text, and the position of each window's first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.full(n, _U(size))
    for j in range(size):
        value = value * _STEP + words[j : j + n]
    # A window is inside a text if no text starts after its first word and up to its last.
    room = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)
    at = np.flatnonzero(room >= size)
    return mix(value[at]), at
