"""Word shingles of whole texts as 64-bit hashes, computed over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

_SEED = np.random.Generator(np.random.PCG64(20240607))
_WORD_SIGN = _SEED.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_PLACE = _SEED.integers(0, 1 << 64, 256, np.uint64, endpoint=False) | np.uint64(1)
_IN_SHINGLE = _SEED.integers(0, 1 << 64, 64, np.uint64, endpoint=False) | np.uint64(1)
_FAR = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
for _c in range(65, 91):  # A-Z count as a-z
    _WORD_SIGN[_c] = _WORD_SIGN[_c + 32]
_WORD_SIGN[_SPACE] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, at: np.ndarray, signs: np.ndarray = _WORD_SIGN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between bytes of sign 0: their hashes, first bytes, ends, and the number of words before each row.

    A word's hash is a sum over its bytes of a random sign for the byte times a random factor for its place.
    """
    inside = signs[raw] != 0
    before = np.empty(len(raw), bool)
    before[1:] = inside[:-1]
    firsts = at[:-1][at[:-1] < len(raw)]
    before[firsts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(len(raw), bool)
    after[:-1] = inside[1:]
    lasts = at[1:][at[1:] > 0] - 1
    after[lasts] = False
    end = np.flatnonzero(inside & ~after) + 1
    counts = np.searchsorted(start, at)
    if not len(start):
        return np.zeros(0, np.uint64), start, end, counts
    span = np.diff(np.append(start, len(raw)))
    place = np.arange(start[0], len(raw)) - np.repeat(start, span)
    factor = _PLACE[place & 255]
    if int((end - start).max()) > 256:
        factor += (place >> 8).astype(np.uint64) * _FAR
    sums = np.add.reduceat(signs[raw[start[0] :]] * factor, start - start[0])
    return mix(sums + (end - start).astype(np.uint64)), start, end, counts


def shingle_sets(raw: np.ndarray, at: np.ndarray, words: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of ``words`` words; of the whole row if it has fewer; empty without words."""
    hashes, _, _, counts = word_hashes(raw, at)
    out = []
    if len(hashes) >= words:
        runs = sum(hashes[k : len(hashes) - words + 1 + k] * _IN_SHINGLE[k] for k in range(words))
        runs = mix(runs)
    for first, last in zip(counts[:-1].tolist(), counts[1:].tolist()):
        n = last - first
        if n >= words:
            out.append(np.unique(runs[first : last - words + 1]))
        elif n:
            whole = (hashes[first:last] * _IN_SHINGLE[:n]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(whole + np.array([n], np.uint64) * _FAR))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    k = np.searchsorted(b, a)
    k[k == len(b)] = 0
    return int((b[k] == a).sum())
