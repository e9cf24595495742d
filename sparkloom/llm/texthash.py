"""Vectorised hashing of text bytes, words and word shingles.

All hashes are 64-bit and depend only on content and fixed constants, so they
agree between executors, runs and batch boundaries.
"""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
#: Bases of two independent rolling hashes, and for each one random 64-bit value for each byte value.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_BYTES = tuple(np.random.Generator(np.random.PCG64(s)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for s in (20240229, 20250301))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POW: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * 2


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[which][0]) < n + 1:
        size = 1 << max(16, n.bit_length())
        made = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        _POW[which] = (made[0], made[1])
    return _POW[which][0][: n + 1], _POW[which][1][: n + 1]


class RollingHash:
    """Hashes of arbitrary slices of one buffer in constant time each."""

    def __init__(self, buf: np.ndarray, which: int = 0):
        power, self.inverse = _powers(len(buf), which)
        self.prefix = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTES[which][buf] * power[:-1], out=self.prefix[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed hashes of ``buf[start:end]`` for arrays of bounds."""
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]

    def windows(self, width: int) -> np.ndarray:
        """Mixed hashes of all slices of ``width`` bytes, by start."""
        n = len(self.prefix) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[width:] - self.prefix[:n]) * self.inverse[:n])


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased.
    A text with fewer words than ``width`` has one shingle, its whole sequence;
    one without words has none.
    """
    if not texts:
        return []
    buf = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    word = np.empty(len(buf) + 1, np.int8)
    word[0] = 0
    word[1:] = ~_SPACE[buf]
    edge = np.diff(word)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = mix(RollingHash(buf).slices(starts, ends) ^ (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, bounds)
    run = words[: max(0, len(words) - width + 1)].copy()
    for k in range(1, width):
        run *= np.uint64(0xD6E8FEB86659FD93)
        run += words[k : k + len(run)]
    run = mix(run)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(run[a : b - width + 1]))
        elif b > a:
            out.append(mix(np.array([_short(words[a:b])], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _short(words: np.ndarray) -> int:
    value = len(words)
    for w in words.tolist():
        value = (value * 0xD6E8FEB86659FD93 + w + 0x5851F42D4C957F2D) & 0xFFFFFFFFFFFFFFFF
    return value


def pieces(texts: list[bytes], limit: int = 1 << 20):
    """Consecutive index ranges of ``texts`` of about ``limit`` bytes each (one text at least)."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def as_bytes(column) -> list[bytes]:
    """The values of an Arrow string column as UTF-8; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()
