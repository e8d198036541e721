"""Vectorised word scanning of Arrow string columns.

Texts are handled as one byte array per slice of about a megabyte, so memory
does not grow with the number of rows; a longer text gets a slice of its own.
Words and n-grams are represented by 64-bit hashes: multilinear over bytes with
fixed random factors, then mixed. Two different ones collide with probability
of about 2^-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_BYTES = np.arange(256, dtype=np.uint8)
#: Lower-cases A-Z only.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes of words that are separated by white space.
NOT_SPACE = ~np.isin(_BYTES, [0x20, *range(0x09, 0x0E)])
#: Bytes of words made of letters and digits; all of UTF-8's longer characters count.
ALNUM = (_BYTES >= 128) | np.isin(_BYTES, list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def factors(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit factors."""
    steps = np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)
    return mix(steps * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_PLACES = factors(1 << 12, 1)


def places(n: int) -> np.ndarray:
    return _PLACES[:n] if n <= len(_PLACES) else factors(n, 1)


def slices(
    column: pa.Array, limit: int = SLICE_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows) per slice; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), len(column))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word's number per row (one more at the end)."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    w = inside[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty_like(w)
    before[0] = False
    before[1:] = w[:-1]
    starts = np.flatnonzero(w & (~before | first[:-1]))
    after = np.empty_like(w)
    after[-1] = False
    after[:-1] = w[1:]
    ends = np.flatnonzero(w & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.empty(0, np.uint64)
    length = ends - starts
    total = int(length.sum())
    place = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    at = place + np.repeat(starts, length)
    value = (data[at].astype(np.uint64) + np.uint64(1)) * places(int(length.max()))[place]
    return mix(np.add.reduceat(value, np.cumsum(length) - length) + length.astype(np.uint64))
