"""Words of whole Arrow text columns as hashes, found with numpy on the UTF-8 bytes.

Work goes in pieces of about ``PIECE`` bytes of whole texts, so memory does not depend
on the batch; one text longer than a piece is a piece by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_VALUE = LOWER.astype(np.uint64) + np.uint64(1)
_EXACT_VALUE = np.arange(1, 257, dtype=np.uint64)

NOT_BLANK = np.ones(256, bool)  # a word is what lies between ASCII white space
NOT_BLANK[[32, *range(9, 14)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for base in (_BASE, inverse):
        column = np.full(size, base, np.uint64)
        column[0] = 1
        out.append(np.cumprod(column, dtype=np.uint64))
    return out[0], out[1]


def _powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(PIECE.bit_length(), int(n).bit_length()))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, nulls as empty, and where each text starts and ends."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``PIECE`` bytes together."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def cuts(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_BLANK
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Bytes of about ``PIECE`` each: the first text's number, the bytes, where its texts start and end.

    Short texts share a piece; a text longer than a piece comes in several, cut between
    words, so what is found in a text adds up over the pieces with its number.
    """
    for a, b in pieces(offsets):
        start, end = offsets[a], offsets[b]
        if end - start <= PIECE:
            yield a, data[start:end], offsets[a : b + 1] - start
            continue
        while start < end:
            stop = min(start + PIECE, end)
            while stop < end and is_word[data[stop]]:
                near = data[stop : min(stop + 4096, end)]
                blank = np.flatnonzero(~is_word[near])
                stop += blank[0] if len(blank) else len(near)
            yield a, data[start:stop], np.array([0, stop - start])
            start = stop


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_BLANK):
    """Start and end of every word, and the number of the first word of each text."""
    inside = is_word[data]
    edges = np.zeros(len(data) + 1, bool)
    edges[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before &= ~edges[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after &= ~edges[1:]
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_BLANK, lower: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (A-Z as a-z), and where each text's words start."""
    start, end, first = word_spans(data, offsets, is_word)
    power, inverse = _powers_for(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_VALUE if lower else _EXACT_VALUE)[data] * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start]), first


def hashed_texts(column: pa.Array, **kw) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each piece of the column: its first text's number, word hashes and word starts."""
    data, offsets = utf8(column)
    for a, b in pieces(offsets):
        part = data[offsets[a] : offsets[b]]
        hashes, first = word_hashes(part, offsets[a : b + 1] - offsets[a], **kw)
        yield a, hashes, first


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive words, across text ends too."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= np.uint64(0x100000001B3)
        out += hashes[k : k + n]
    return mix(out)


def list_column(values: np.ndarray, lengths, kind: pa.DataType) -> pa.Array:
    """Consecutive runs of ``values`` as an Arrow list column."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
