"""Words and shingles of many texts at once, as numpy arrays of 64-bit hashes.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D, with A-Z lower-cased.  Its hash
is a polynomial over its bytes, taken as a difference of running sums, and then mixed.
"""

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15  # odd: it has an inverse modulo 2**64
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n - 1."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        both = []
        for x in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, x, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _powers = tuple(both)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of rows laid end to end, and the n+1 word offsets of the rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~BLANK[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (first[:-1] | ~inside[:-2]))
    ends = np.flatnonzero(inside[1:-1] & (first[1:] | ~inside[2:])) + 1
    power, inverse = _grow(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(hashes), np.searchsorted(starts, offsets)


def shingle_sets(hashes: np.ndarray, rows: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each row its distinct shingles, ascending; a row of fewer words is one shingle, one without words has none."""
    count = len(hashes) - width + 1
    rolling = np.zeros(max(count, 0), np.uint64)
    for k in range(width if count > 0 else 0):
        rolling = rolling * np.uint64(_BASE) + hashes[k : k + count]
    rolling = mix(rolling)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= width:
            own = np.sort(rolling[a : b - width + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            value = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    value = value * np.uint64(_BASE) + h
            out.append(mix(np.array([value], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
