"""Word hashes of UTF-8 texts, whole arrays at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BASE = 0x2545F4914F6CDD1D
_rising: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, the tables doubling as needed."""
    for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
        table = _rising[k]
        while len(table) <= n:
            table = np.concatenate([table, table * np.uint64(pow(base, len(table), 1 << 64))])
        _rising[k] = table
    return _rising[0], _rising[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each text; none for a null."""
    for value in column:
        raw = value.as_buffer() if value.is_valid else None
        yield np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)


def words(data: np.ndarray) -> np.ndarray:
    """Hashes of the words between white space, A-Z lower-cased, in order."""
    if not len(data):
        return np.zeros(0, dtype=np.uint64)
    gap = _GAP[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    with np.errstate(over="ignore"):
        up, down = powers(len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((_LOWER[data].astype(np.uint64) + _M1) * up[: len(data)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * down[starts])


def runs(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` words in a row; of all words, if there are fewer."""
    n = len(word_hashes)
    size = min(size, n)
    if not n:
        return word_hashes
    with np.errstate(over="ignore"):
        out = word_hashes[: n - size + 1].copy()
        for k in range(1, size):
            out *= _M1
            out += word_hashes[k : n - size + 1 + k]
        return mixed(out + np.uint64(size))
