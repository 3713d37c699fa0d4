"""Arrow text columns as numpy bytes, and fingerprints of their pieces.

A piece ``data[s:e]`` has the polynomial fingerprint sum T[b_j] r^(j-s) modulo
2^64 (r odd, so powers divide), got from one running sum over the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_RNG = np.random.default_rng(20240607)
TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``r^i`` and ``r^-i`` for i < n at least, modulo 2^64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, BLOCK + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.empty(size, np.uint64)
            out[0], have = 1, 1
            with np.errstate(over="ignore"):
                while have < size:
                    take = min(have, size - have)
                    out[have : have + take] = out[:take] * np.uint64(pow(base, have, 1 << 64))
                    have += take
            _POWERS[name] = out
    return _POWERS["up"], _POWERS["down"]


def running(data: np.ndarray) -> np.ndarray:
    """Running sums H with H[i] over data[:i]; data are bytes, or 64-bit codes of words."""
    up, _ = powers(len(data) + 1)
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum((TABLE[data] if data.dtype == np.uint8 else data) * up[: len(data)], out=out[1:])
    return out


def fingerprints(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed fingerprints of the pieces ``[starts, ends)``; the length takes part."""
    _, down = powers(len(sums))
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1) of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = at.astype(np.int64)
    return raw[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odd fingerprints of the words (``[^\\x20\\x09-\\x0D]+``) of each row's bytes, and the rows' offsets in them."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    letter = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]  # words end with their row
    first[edge] = letter[edge]
    last[edge - 1] = letter[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return fingerprints(running(data), starts, ends) | np.uint64(1), np.searchsorted(starts, offsets)


def blocks(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
