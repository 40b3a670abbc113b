"""Vectorised 64-bit hashes of words and of byte windows, for numpy code inside tasks.

A prefix sum of table[byte] * base**i gives any substring's hash from two entries, once divided by base**start; the base is
odd, so that division is a product with its inverse modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
TABLE = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64)
#: Bytes of text to treat at once: each takes about 50 bytes of memory.
CHUNK = 1 << 20

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's and its inverse's powers from 0 to n - 1 at least."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n + n // 4, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def prefix_sums(b: np.ndarray) -> np.ndarray:
    up, _ = powers(len(b) + 1)
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(TABLE[b] * up[: len(b)], dtype=np.uint64, out=out[1:])
    return out


def substring_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) with at most so many bytes, or a single text, at once."""
    first, held, total = 0, [], 0
    for i, x in enumerate(texts):
        if held and total + len(x) > size:
            yield first, held
            first, held, total = i, [], 0
        held.append(x)
        total += len(x)
    if held:
        yield first, held


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of the values of an Arrow string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of all texts, A-Z lower-cased, and how many words each text has."""
    # A space after each text keeps words apart.
    b = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    gap = _SPACE[b]
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    hashes = substring_hashes(prefix_sums(b), start, end)
    ends = np.cumsum([len(x) + 1 for x in texts]) if texts else np.zeros(0, np.int64)
    upto = np.searchsorted(start, ends)
    return hashes, np.diff(upto, prepend=0)


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the words that word_hashes() gives begins and ends."""
    edge = np.flatnonzero(np.diff(_SPACE[np.frombuffer(text, np.uint8)], prepend=True, append=True))
    return edge[::2], edge[1::2]
