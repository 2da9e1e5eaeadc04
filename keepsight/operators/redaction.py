"""Redaction of text columns, at any number of registered secrets.

Registered values are found by an index of windows: each value has an anchor, the one of
its windows of eight bytes that fewest others share, and every window of a text is looked
up among the anchors in one numpy pass. Only rows that hold a value are folded, longest
value first; the index says which value is next, also after a marker has been put in.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsight.functions.redaction import (
    MARKER,
    MIN_SECRET_CHARS,
    marker_count,
    redact_known,
    redact_shapes,
    usable_secrets,
)
from keepsight.sources.shared import shared_path

#: Bytes of registered values that one pass over the texts looks for.
BLOCK_BYTES = 32 << 20


class SecretIndex:
    """Finds which of ``values``, in the order of the fold, a text holds."""

    _GOLDEN, _BITS, _PIECE = np.uint64(0x9E3779B97F4A7C15), 22, 1 << 20

    def __init__(self, values: Sequence[str]) -> None:
        self.values = [v.encode() for v in values]
        self.size = np.array([len(v) for v in self.values], np.int64)
        start = np.cumsum(self.size) - self.size
        windows = self._windows(np.frombuffer(b"".join(self.values), np.uint8))
        inside = np.repeat(self.size - 7, self.size - 7)
        owner = np.repeat(np.arange(len(self.values)), self.size - 7)
        offset = np.arange(len(inside)) - np.repeat(np.cumsum(self.size - 7) - (self.size - 7), self.size - 7)
        windows = windows[start[owner] + offset]
        _, which, often = np.unique(windows, return_inverse=True, return_counts=True)
        order = np.lexsort((offset, often[which], owner))
        first = order[np.searchsorted(owner[order], np.arange(len(self.values)))]  # each value's rarest window
        first = first[np.argsort(windows[first], kind="stable")]
        self.owner, self.offset = owner[first], offset[first]
        self.keys, self.first = np.unique(windows[first], return_index=True)
        self.first = np.append(self.first, len(first))
        self.seen = np.zeros(1 << self._BITS, bool)
        self.seen[self._place(self.keys)] = True

    @staticmethod
    def _windows(data: np.ndarray) -> np.ndarray:
        n = max(len(data) - 7, 0)
        return np.ndarray((n,), "<u8", np.ascontiguousarray(data), strides=(1,)).copy()

    def _place(self, windows: np.ndarray) -> np.ndarray:
        return (windows * self._GOLDEN) >> np.uint64(64 - self._BITS)

    def hits(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """``(value, start)`` of every place in the bytes where a value stands."""
        blob = memoryview(data)
        for at in range(0, max(len(data) - 7, 0), self._PIECE):
            windows = self._windows(data[at : at + self._PIECE + 7])
            near = np.flatnonzero(self.seen[self._place(windows)])
            key = np.searchsorted(self.keys, windows[near])
            key[key == len(self.keys)] = 0
            same = self.keys[key] == windows[near]
            for place, k in zip((near[same] + at).tolist(), key[same].tolist()):
                for anchor in range(self.first[k], self.first[k + 1]):
                    value, begin = self.owner[anchor], place - self.offset[anchor]
                    end = begin + self.size[value]
                    if begin >= 0 and end <= len(blob) and blob[begin:end] == self.values[value]:
                        yield int(value), int(begin)

    def fold(self, text: bytes) -> bytes:
        """``text`` with each value replaced in turn; one that a marker has completed counts in its turn."""
        turn = 0
        while True:
            due = min((v for v, _ in self.hits(np.frombuffer(text, np.uint8)) if v >= turn), default=None)
            if due is None:
                return text
            text, turn = text.replace(self.values[due], MARKER.encode()), due + 1

    def redacted(self, column: pa.Array) -> pa.Array:
        """The column with every row folded that holds a value."""
        texts = column.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        rows = set()
        for value, begin in self.hits(data[offsets[0] : offsets[-1]]):
            row = int(np.searchsorted(offsets, begin + offsets[0], "right")) - 1
            if begin + offsets[0] + self.size[value] <= offsets[row + 1]:
                rows.add(row)
        if not rows:
            return column
        mask = np.zeros(len(column), bool)
        mask[list(rows)] = True
        folded = [self.fold(texts[row].as_py()).decode() for row in sorted(rows)]
        return pc.replace_with_mask(column, pa.array(mask), pa.array(folded, column.type))


def redact_values(df: DataFrame, cols: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``cols`` without the registered ``values`` (usable ones, in the order of the fold); no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(list(values))

    @F.arrow_udf("string")
    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = SecretIndex(shared.value)
        for column in batches:
            yield index.redacted(column)

    return df.withColumns({c: known(F.col(c).cast("string")) for c in cols}) if values else df


def _blocks(secrets: DataFrame, size: int) -> Iterator[list[str]]:
    """The usable values in the order of the fold, in lists of about ``size`` bytes."""
    ordered = _usable(secrets).orderBy(F.desc(F.length("value")), "value")
    block, held = [], 0
    for row in ordered.toLocalIterator():
        if block and held + len(row["value"]) > size:
            yield block
            block, held = [], 0
        block.append(row["value"])
        held += len(row["value"].encode())
    if block:
        yield block


def rejected_secrets(secrets: DataFrame) -> DataFrame:
    """Registered values that are not matched: too short, or part of the marker."""
    return secrets.select(
        "value",
        F.when(F.length("value") < MIN_SECRET_CHARS, F.lit("too_short"))
        .when(F.lit(MARKER).contains(F.col("value")), F.lit("inside_marker"))
        .alias("reason"),
    ).filter(F.col("reason").isNotNull())


def _usable(secrets: DataFrame) -> DataFrame:
    value = F.col("value")
    return (
        secrets.select("value")
        .filter((F.length(value) >= MIN_SECRET_CHARS) & ~F.lit(MARKER).contains(value))
        .distinct()
    )


def redact(
    df: DataFrame,
    cols: Sequence[str],
    secrets: DataFrame | Sequence[str] = (),
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Redact text columns: registered values, longest first, then credential shapes.

    ``secrets`` is a table with a ``value`` column, or a list. Every number of values goes
    the same way, and the result is that of replacing one after another. Values come to the
    driver and the tasks ``block_bytes`` at a time; after each block but the last the rows
    are written to the shared folder, so no task holds more than one.
    """
    if not isinstance(secrets, DataFrame):
        known = redact_values(df, cols, usable_secrets(secrets))
        return known.withColumns({c: redact_shapes(F.col(c)) for c in cols})
    spark, last = df.sparkSession, None
    for block in _blocks(secrets, block_bytes):
        if last is not None:
            path = shared_path(spark, "redacting")
            redact_values(df, cols, last).write.parquet(path)
            df = spark.read.schema(df.schema).parquet(path)
        last = block
    known = redact_values(df, cols, last or [])
    return known.withColumns({c: redact_shapes(F.col(c)) for c in cols})


def redaction_report(
    df: DataFrame, col: str, source: str, secrets: Sequence[str] = ()
) -> DataFrame:
    """Per source: rows changed, and markers put in by each layer."""
    rows = (
        df.select(source, F.col(col).alias("_before"))
        .withColumn("_known", redact_known(F.col("_before"), secrets))
        .withColumn("_after", redact_shapes(F.col("_known")))
    )
    held, known_n, after_n = (marker_count(F.col(c)) for c in ("_before", "_known", "_after"))
    return rows.groupBy(source).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_before") != F.col("_after")).alias("rows_changed"),
        F.coalesce(F.sum(known_n - held), F.lit(0)).cast("bigint").alias("known_markers"),
        F.coalesce(F.sum(after_n - known_n), F.lit(0)).cast("bigint").alias("shape_markers"),
    )
