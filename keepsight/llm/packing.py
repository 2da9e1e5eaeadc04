"""Hierarchical packing of documents into context windows of several sizes.

A document's ids fill whole windows of the largest size first. Its rest is routed to the
smallest tier it fits. Tiers are packed from the largest down: a window starts with a rest
of its own tier, and its gap is filled with rests waiting in the shorter tiers, the longest
that fits first, the last one cut to size. A window that nothing is left to fill, at most
one in a partition, goes out as full windows of smaller powers of two. So every sequence
is exactly full.

Packing happens where the documents lie: no shuffle, and memory for one buffer of rests.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsight.llm.bpe import vocabulary


@dataclass(frozen=True)
class Packing:
    """``tiers`` (powers of two, largest first), rests that wait together in a ``buffer``,
    and ids in one ``step`` group."""

    tiers: tuple[int, ...] = (1024, 512, 256, 128)
    buffer: int = 4096
    step: int = 8192
    end_id: int = 0

    def __post_init__(self):
        if any(t & (t - 1) for t in self.tiers) or sorted(self.tiers, reverse=True) != list(self.tiers):
            raise ValueError("tiers must be powers of two, the largest first")


@dataclass
class _Piece:
    doc: tuple  # id and number of ids of the document
    start: int
    ids: np.ndarray


@dataclass
class _Packer:
    """Packs one partition's documents; finished sequences wait in ``done`` by their length."""

    how: Packing
    waiting: list = field(default_factory=list)  # (length, number, piece), shortest first
    held: int = 0  # ids that wait
    number: int = 0
    done: list[list[_Piece]] = field(default_factory=list)

    def add(self, doc: tuple, ids: np.ndarray) -> None:
        largest = self.how.tiers[0]
        whole = len(ids) // largest * largest
        for start in range(0, whole, largest):
            self.done.append([_Piece(doc, start, ids[start : start + largest])])
        if whole < len(ids):
            self._wait(_Piece(doc, whole, ids[whole:].copy()))
        if len(self.waiting) >= self.how.buffer:
            self.flush()

    def _wait(self, piece: _Piece) -> None:
        insort(self.waiting, (len(piece.ids), self.number, piece))
        self.number += 1
        self.held += len(piece.ids)

    def _take(self, at: int) -> _Piece:
        length, _, piece = self.waiting.pop(at)
        self.held -= length
        return piece

    def flush(self, last: bool = False) -> None:
        """Pack what waits, longest tier first; before the last, less than one window waits on."""
        while self.waiting and (last or self.held >= self.how.tiers[0]):
            self._window()

    def _window(self) -> None:
        first = self._take(-1)
        tier = min(t for t in self.how.tiers if t >= len(first.ids))
        window, gap = [first], tier - len(first.ids)
        while gap and self.waiting:
            fits = bisect_right(self.waiting, gap, key=lambda w: w[0]) - 1
            piece = self._take(max(fits, 0))
            if len(piece.ids) > gap:
                self._wait(_Piece(piece.doc, piece.start + gap, piece.ids[gap:]))
                piece = _Piece(piece.doc, piece.start, piece.ids[:gap])
            window.append(piece)
            gap -= len(piece.ids)
        if gap:
            self._halve(window, tier - gap)
        else:
            self.done.append(window)

    def _halve(self, window: list[_Piece], held: int) -> None:
        """The ids of a window that nothing is left to fill, as full windows of powers of two."""
        while held:
            size = 1 << (held.bit_length() - 1)
            part, need = [], size
            while need:
                piece = window.pop(0)
                if len(piece.ids) > need:
                    window.insert(0, _Piece(piece.doc, piece.start + need, piece.ids[need:]))
                    piece = _Piece(piece.doc, piece.start, piece.ids[:need])
                part.append(piece)
                need -= len(piece.ids)
            self.done.append(part)
            held -= size


@dataclass
class _Steps:
    """Gives sequences to step groups of equal ids: one length each, and one mixed last group."""

    how: Packing
    first: int
    open: dict[int, list] = field(default_factory=dict)
    groups: int = 0

    def add(self, sequence: list[_Piece]) -> list[tuple[int, list[_Piece]]]:
        size = sum(len(p.ids) for p in sequence)
        own = self.open.setdefault(size, [])
        own.append(sequence)
        return self._close(self.open.pop(size)) if size * len(own) >= self.how.step else []

    def _close(self, sequences: list) -> list[tuple[int, list[_Piece]]]:
        group = self.first + self.groups
        self.groups += 1
        return [(group, s) for s in sequences]

    def rest(self) -> list[tuple[int, list[_Piece]]]:
        out, part, held = [], [], 0
        for size in sorted(self.open, reverse=True):
            for sequence in self.open[size]:
                part.append(sequence)
                held += size
                if held >= self.how.step:
                    out += self._close(part)
                    part, held = [], 0
        return out + (self._close(part) if part else [])


def packed(
    docs: DataFrame,
    how: Packing = Packing(),
    id_col: str = "doc_id",
    text_col: str = "text",
    vocab: str = "byte_bpe_50k.tiktoken",
    definition: str | None = "byte_bpe_50k.json",
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of every document, each with its sequence and its place there.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_length, step_group`` and, if asked, ``ids``. Every document ends with
    ``end_id``, so an empty or null text is that one id, in one piece. Sequence and group
    numbers are unique, not without gaps. Equal rows are packed each by itself. An empty
    table gives no pieces; other columns are not read.
    """
    kind = docs.schema[id_col].dataType
    fields = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_length int, step_group bigint"
    schema = T.StructType([T.StructField("doc_id", kind)] + T.StructType.fromDDL(fields).fields)
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))
    names = schema.fieldNames()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = vocabulary(vocab, definition), np.array([how.end_id], np.uint32)
        base = TaskContext.get().partitionId() << 32
        packer, steps, sequences = _Packer(how), _Steps(how, base), base

        def rows(done: list) -> Iterator[tuple]:
            nonlocal sequences
            for group, sequence in done:
                offset, size = 0, sum(len(p.ids) for p in sequence)
                for p in sequence:
                    n = len(p.ids)
                    row = (p.doc[0], p.start, n, zlib.crc32(p.ids.tobytes()), p.doc[1], sequences, offset, size, group)
                    yield (*row, p.ids.astype(np.int64)) if with_ids else row
                    offset += n
                sequences += 1

        def finished() -> list:
            done = [x for s in packer.done for x in steps.add(s)]
            packer.done.clear()
            return done

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) if found else [()] * len(names)
            types = [id_type, *[pa.int64()] * 6, pa.int32(), pa.int64(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            found = []
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = np.concatenate([bpe.ids(text.as_py() or ""), end])
                packer.add((doc.as_py(), len(ids)), ids)
                if len(packer.done) > 512:
                    found += rows(finished())
                if len(found) > 8192:
                    yield batch_of(found)
                    found = []
            yield batch_of(found)
        packer.flush(last=True)
        yield batch_of(list(rows(finished() + steps.rest())))

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(pack, schema)
