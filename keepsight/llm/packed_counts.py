"""Counts by 64-bit key, shuffled and kept as packed blocks.

A block holds sorted keys of one range with two counts each, as differences in byte planes
under zstd: a few bytes a key. Each task adds up its own rows first; blocks of one range
are then added one after another, so memory holds the distinct keys of one range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PENDING = 1 << 21
RANGES = 1 << 12
BLOCK = "place int, n int, block binary"
_NAMES = ["place", "n", "block"]
Counts = tuple[np.ndarray, np.ndarray, np.ndarray]  # keys, first and second count


def none() -> Counts:
    return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)


def added(parts: list[Counts]) -> Counts:
    """One sorted row a key with the sums of its counts."""
    keys, a, b = (np.concatenate(x) for x in zip(none(), *parts))
    if not len(keys):
        return none()
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(a[order], at), np.add.reduceat(b[order], at)


def pack(counts: Counts) -> bytes:
    keys, a, b = counts
    step = np.diff(keys, prepend=np.uint64(0))
    planes = [x.astype("<i8" if x.dtype.kind == "i" else "<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in (step, a, b)]
    return pa.Codec("zstd").compress(b"".join(planes), asbytes=True)


def unpack(block: bytes, n: int) -> Counts:
    raw = np.frombuffer(pa.Codec("zstd").decompress(block, decompressed_size=24 * n, asbytes=True), np.uint8)
    step, a, b = (np.ascontiguousarray(x.T).view("<u8").ravel() for x in raw.reshape(3, 8, n))
    return np.cumsum(step, dtype=np.uint64), a.astype(np.int64), b.astype(np.int64)


def blocks(counts: Counts, space: int, ranges: int = RANGES) -> Iterator[pa.RecordBatch]:
    """Packed rows of sorted counts whose keys lie below ``space``, cut into ``ranges`` ranges."""
    if not len(counts[0]):
        return
    place = (counts[0] // np.uint64(max(1, -(-space // ranges)))).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
    for k in range(0, len(cut) - 1, 256):
        spans = list(zip(cut[k : k + 256], cut[k + 1 : k + 257]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([place[i] for i, _ in spans], pa.int32()),
                pa.array([j - i for i, j in spans], pa.int32()),
                pa.array([pack(tuple(x[i:j] for x in counts)) for i, j in spans], pa.binary()),
            ],
            _NAMES,
        )


def counted(keys: Iterator[np.ndarray], space: int, second: bool) -> Iterator[pa.RecordBatch]:
    """Blocks of how often each key occurs, as the first or the second count."""
    parts, pending = [], 0
    for found in keys:
        found, n = np.unique(found, return_counts=True)
        zero = np.zeros(len(n), np.int64)
        parts.append((found, zero, n) if second else (found, n, zero))
        pending += len(found)
        if pending >= PENDING:
            parts = [added(parts)]
            pending = len(parts[0][0])
            if pending >= PENDING // 2:
                yield from blocks(parts[0], space)
                parts, pending = [], 0
    yield from blocks(added(parts), space)


def totals(found: DataFrame, space: int) -> DataFrame:
    """One block for each range, of the sums of all blocks; keys whose first count is below 2 are left out."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_rows(batches), itemgetter(0)):
            yield from blocks(twice(summed(unpack(block, n) for _, n, block in rows)), space)

    return found.repartition("place").sortWithinPartitions("place").mapInArrow(total, BLOCK)


def summed(parts: Iterable[Counts]) -> Counts:
    """The sum of many counts, added up whenever as many rows have come as it holds."""
    waiting, fresh, held = [], 0, 0
    for part in parts:
        waiting.append(part)
        fresh += len(part[0])
        if fresh >= max(PENDING, held):
            waiting = [added(waiting)]
            fresh, held = 0, len(waiting[0][0])
    return added(waiting)


def twice(counts: Counts) -> Counts:
    """Without the keys whose first count is below 2."""
    keep = counts[1] > 1
    return tuple(x[keep] for x in counts)


def level(n: np.ndarray) -> np.ndarray:
    """Eight steps for each doubling of a count."""
    return np.floor(8 * np.log2(np.maximum(n, 1))).astype(np.int32)


def most_frequent(table: DataFrame, limit: int, always: int | None = None) -> Counts:
    """All keys at or above the lowest level of the first count that leaves at most ``limit`` keys.

    Keys of one level stay or go together. Keys from ``always`` on stay besides.
    """
    other = np.uint64((1 << 64) - 1 if always is None else always)

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(8 * 64, np.int64)
        for _, n, block in _rows(batches):
            keys, a, _b = unpack(block, n)
            sums += np.bincount(level(a[keys < other]), minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["level", "n"])

    rows = table.mapInArrow(levels, "level int, n bigint").groupBy("level").agg(F.sum("n").alias("n")).collect()
    lowest, held = 8 * 64, 0
    for row in sorted(rows, key=lambda r: -r["level"]):
        held += row["n"]
        if held > limit:
            break
        lowest = row["level"]

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, n, block in _rows(batches):
            counts = unpack(block, n)
            keep = (level(counts[1]) >= lowest) | (counts[0] >= other)
            if keep.any():
                kept = tuple(x[keep] for x in counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place], pa.int32()), pa.array([len(kept[0])], pa.int32()), pa.array([pack(kept)], pa.binary())],
                    _NAMES,
                )

    found = table.mapInArrow(chosen, BLOCK).toArrow()
    return added([unpack(b, n) for b, n in zip(found["block"].to_pylist(), found["n"].to_pylist())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in range(3)))


def count_table(rows: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], space: int, second: bool = False) -> DataFrame:
    """Blocks of the keys that ``keys_of`` finds in each task's rows."""
    return rows.mapInArrow(lambda batches: counted(keys_of(batches), space, second), BLOCK)
