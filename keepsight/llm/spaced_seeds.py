"""Benchmark decontamination with spaced seeds.

A seed hashes the words at the positions a fixed mask marks and ignores those between, so
a changed word spoils only the seeds that look at it. Seeds of the benchmark are joined
with seeds of the corpus; around each hit the words of both sides are aligned, and the
longest stretch that agrees in a large enough share of its words decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsight.llm import bitmap as bitmaps
from keepsight.llm.storage import Scratch
from keepsight.llm.words import hashed_texts, list_column, mix


@dataclass(frozen=True)
class Seeds:
    """The ``masks`` together hit every 15-word passage with three words changed.

    A passage counts from ``min_words`` words (the whole item, if shorter) of which
    ``percent`` agree. ``around`` words on either side of a hit are kept for alignment.
    ``bits`` of the filter of benchmark seeds; it only spares work.
    """

    masks: tuple[str, ...] = ("1110101", "1001111", "10001111", "11011001")
    min_words: int = 13
    percent: int = 80
    around: int = 24
    bits: int = 1 << 25

    @property
    def shortest(self) -> int:
        return min(map(len, self.masks))


def seed_hashes(hashes: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The seed at every word where ``mask`` fits, across text ends too."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, number + 1, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out *= np.uint64(0x100000001B3)
            out += hashes[k : k + n]
    return mix(out)


def _whole(length: int, how: Seeds) -> tuple[str, int]:
    """The mask, and its number, that takes an item too short for any other as it is."""
    return "1" * length, len(how.masks) + length


def _keys() -> Iterator[int]:
    key = TaskContext.get().partitionId() << 40
    while True:
        yield key
        key += 1


def item_seeds(items: DataFrame, id_col: str, text_col: str, how: Seeds) -> DataFrame:
    """``item, item_id, words, seeds, at``: an item's word hashes, and its seeds with their places."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = _keys()
        for batch in batches:
            at = 0
            for _, hashes, first in hashed_texts(batch.column(1)):
                n = len(first) - 1
                ids, words, seeds, places = batch.column(0).slice(at, n), [], [], []
                at += n
                for a, b in zip(first[:-1], first[1:]):
                    own = hashes[a:b]
                    masks = [(m, k) for k, m in enumerate(how.masks)]
                    if 0 < len(own) < how.shortest:
                        masks = [_whole(len(own), how)]
                    found = [seed_hashes(own, m, k) for m, k in masks]
                    words.append(own.astype(np.int64))
                    seeds.append(np.concatenate(found).astype(np.int64))
                    places.append(np.concatenate([np.arange(len(f)) for f in found]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([next(keys) for _ in range(n)], pa.int64()),
                        ids,
                        pa.array(words, pa.list_(pa.int64())),
                        pa.array(seeds, pa.list_(pa.int64())),
                        pa.array(places, pa.list_(pa.int32())),
                    ],
                    ["item", "item_id", "words", "seeds", "at"],
                )

    rows = items.select(F.col(id_col).cast("bigint"), text_col)
    return rows.mapInArrow(read, "item bigint, item_id bigint, words array<bigint>, seeds array<bigint>, at array<int>")


def _stretches(hits: np.ndarray, first: np.ndarray, around: int, span: int) -> tuple[np.ndarray, ...]:
    """Text, first hit and last hit (as places in ``hits``) of the hits whose contexts meet."""
    text = np.searchsorted(first, hits, "right") - 1
    new = np.ones(len(hits), bool)
    new[1:] = (text[1:] != text[:-1]) | (hits[1:] - hits[:-1] > 2 * around + span)
    begin = np.flatnonzero(new)
    return text[begin], begin, np.append(begin[1:], len(hits))


def candidates(
    docs: DataFrame, filled: np.ndarray, id_col: str, text_col: str, how: Seeds, short: tuple[int, ...] = ()
) -> DataFrame:
    """``key, doc_id, start, words, seeds, at``: stretches of texts around seeds that pass the filter.

    ``at`` counts words within the stretch, ``start`` is its first word in the text.
    ``short`` are the lengths of items that are looked for whole.
    """
    masks = [*((m, k) for k, m in enumerate(how.masks)), *(_whole(n, how) for n in short)]
    shared = docs.sparkSession.sparkContext.broadcast(filled)
    span = max(map(len, how.masks))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, marked = _keys(), shared.value
        for batch in batches:
            base = 0
            for _, hashes, first in hashed_texts(batch.column(1)):
                ids = batch.column(0).slice(base, len(first) - 1)
                base += len(first) - 1
                last_word = np.repeat(first[1:], np.diff(first))  # where each word's text ends
                at, seeds = [], []
                for mask, k in masks:
                    seed = seed_hashes(hashes, mask, k)
                    places = np.flatnonzero(bitmaps.holds(marked, (seed & np.uint64(how.bits - 1)).astype(np.int64)))
                    places = places[places + len(mask) <= last_word[places]]
                    at.append(places)
                    seeds.append(seed[places])
                at, seeds = np.concatenate(at), np.concatenate(seeds)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, seeds = at[order], seeds[order]
                text, begin, end = _stretches(at, first, how.around, span)
                low = np.maximum(at[begin] - how.around, first[text])
                high = np.minimum(at[end - 1] + span + how.around, first[text + 1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([next(keys) for _ in text], pa.int64()),
                        ids.take(pa.array(text)),
                        pa.array(low - first[text], pa.int64()),
                        pa.array([hashes[a:b].astype(np.int64) for a, b in zip(low, high)], pa.list_(pa.int64())),
                        list_column(seeds.astype(np.int64), end - begin, pa.int64()),
                        list_column((at - np.repeat(low, end - begin)).astype(np.int32), end - begin, pa.int32()),
                    ],
                    ["key", "doc_id", "start", "words", "seeds", "at"],
                )

    rows = docs.select(F.col(id_col).cast("bigint"), text_col)
    return rows.mapInArrow(
        read, "key bigint, doc_id bigint, start bigint, words array<bigint>, seeds array<bigint>, at array<int>"
    )


def longest_agreement(equal: np.ndarray, percent: int) -> tuple[int, int]:
    """Start and length of the longest stretch of which ``percent`` is true."""
    score = np.concatenate([[0], np.cumsum(100 * equal.astype(np.int64) - percent)])
    low = np.minimum.accumulate(score)
    high = np.maximum.accumulate(score[::-1])[::-1]
    # for every start that is a new low, the last end that is no lower
    best = (0, 0)
    j = 0
    for i in np.flatnonzero(np.concatenate([[True], low[1:] < low[:-1]])):
        j = max(j, int(i))
        while j + 1 < len(score) and high[j + 1] >= score[i]:
            j += 1
        if j - i > best[1]:
            best = (int(i), int(j - i))
    return best


def overlaps(
    docs: DataFrame,
    items: DataFrame,
    how: Seeds = Seeds(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, item_id, start, length, agreeing``: verified passages of benchmark items in texts.

    ``start`` counts words of the document. Words are what lies between ASCII white space,
    A-Z as a-z. An item of fewer words than the shortest mask is found where all its words
    stand unchanged; an empty or a null text has no overlap; repeated rows are found each by
    itself. Items and documents
    may both be large: the filter has a fixed size, and seeds meet in a shuffle join.
    """
    scratch = Scratch("seeds")
    known = scratch.write(item_seeds(items, item_id_col, item_text_col, how), "items")
    seeds = known.select("item", F.posexplode("seeds").alias("n", "seed"), "at").select(
        "item", "seed", F.element_at("at", F.col("n") + 1).alias("item_at")
    )
    filled = bitmaps.build(seeds, "seed", how.bits)
    length = F.size("words")
    lengths = known.filter((length > 0) & (length < how.shortest)).select(length.alias("n")).distinct()
    short = tuple(sorted(r["n"] for r in lengths.collect()))  # fewer than the shortest mask's words
    found = scratch.write(candidates(docs, filled, id_col, text_col, how, short), "stretches")
    hits = found.select("key", F.posexplode("seeds").alias("n", "seed"), "at").select(
        "key", "seed", F.element_at("at", F.col("n") + 1).alias("at")
    )
    aligned = hits.join(seeds, "seed").select("key", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    both = aligned.join(
        known.select("item", "item_id", F.col("words").alias("item_words")), "item"
    ).join(found.select("key", "doc_id", "start", "words"), "key")
    percent, least = how.percent, how.min_words

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n) for n in ("words", "item_words")]
            (dv, do), (iv, io) = (_lists(c) for c in columns)
            shifts = batch.column("shift").to_numpy()
            keep, starts, lengths, agreeing = [], [], [], []
            for k in range(len(batch)):
                text, item, shift = dv[do[k] : do[k + 1]], iv[io[k] : io[k + 1]], int(shifts[k])
                low, high = max(0, -shift), min(len(item), len(text) - shift)
                equal = text[low + shift : high + shift] == item[low:high]
                at, length = longest_agreement(equal, percent)
                if length >= min(least, len(item)):
                    keep.append(k)
                    starts.append(low + shift + at)
                    lengths.append(length)
                    agreeing.append(int(equal[at : at + length].sum()))
            kept = batch.select(["doc_id", "item_id", "start"]).take(pa.array(keep, pa.int64()))
            begin = kept.column("start").to_numpy() + np.array(starts, np.int64)
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), kept.column(1), pa.array(begin), pa.array(lengths, pa.int64()), pa.array(agreeing, pa.int64())],
                ["doc_id", "item_id", "start", "length", "agreeing"],
            )

    rows = both.select("doc_id", "item_id", "start", "shift", "words", "item_words")
    return scratch.write(
        rows.mapInArrow(verify, "doc_id bigint, item_id bigint, start bigint, length bigint, agreeing bigint"), "overlaps"
    )


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return column.values.to_numpy(zero_copy_only=False), offsets


def contamination(docs: DataFrame, items: DataFrame, how: Seeds = Seeds(), **columns) -> DataFrame:
    """``doc_id, contaminated, item_ids, n_words, best_percent`` of every row of ``docs``.

    ``n_words`` is the longest verified passage, ``best_percent`` its share of equal words.
    Rows that share an id are one document; a row without an id is reported clean. The
    ``item_ids`` of one document are collected: at most one for each of its words' seeds.
    """
    id_col = columns.get("id_col", "doc_id")
    found = overlaps(docs, items, how, **columns)
    share = F.round(100 * F.col("agreeing") / F.col("length"), 2)
    best = found.groupBy("doc_id").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"),
        F.max(F.struct("length", "agreeing", share.alias("share"))).alias("best"),
    )
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id")).join(best, "doc_id", "left")
    return rows.select(
        "doc_id",
        F.col("best").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce("best.length", F.lit(0).cast("bigint")).alias("n_words"),
        F.col("best.share").alias("best_percent"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, how: Seeds = Seeds(), **columns) -> DataFrame:
    """``docs`` without the documents that hold a passage of ``items``; columns stay as they are."""
    id_col = columns.get("id_col", "doc_id")
    bad = overlaps(docs, items, how, **columns).filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, F.col(id_col).cast("bigint") == F.col("_bad"), "left_anti")
