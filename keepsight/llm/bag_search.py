"""Ranked lexical search: equal bags are scored once.

Documents are cut down to the words of the items. Those with the same word counts and the
same length figure form one class, found by a hash and told apart by the counts
themselves; a class is scored once, and its first members by id stand for it. Classes lie
where Spark has dealt them and each task keeps its best rows of every item, so what is
shuffled after scoring grows with items and tasks, not with documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsight.llm.storage import Scratch
from keepsight.llm.words import LOWER, cuts, list_column, utf8, word_spans

#: Letters and digits of ASCII, and every byte beyond it.
TERM = np.zeros(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    TERM[_low:_high] = True


@dataclass(frozen=True)
class Search:
    """``top`` documents of an item; ``postings`` words of items that are searched at once."""

    top: int = 10
    postings: int = 1 << 17


def _terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """For each piece: its first text's number, the words of each text, and all words."""
    data, offsets = utf8(column)
    for at, part, ends in cuts(data, offsets, TERM):
        start, end, first = word_spans(part, ends, TERM)
        places = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
        body = LOWER[part[TERM[part]]]
        buffers = [None, pa.py_buffer(places), pa.py_buffer(body)]
        yield at, np.diff(first), pa.Array.from_buffers(pa.large_binary(), len(start), buffers)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The distinct ``item, term`` pairs; rows that share an id are one item."""
    kind = items.schema[id_col].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, counts, words in _terms(batch.column(1)):
                rows = pa.array(np.repeat(np.arange(at, at + len(counts)), counts))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), words.cast(pa.binary())], ["item", "term"])

    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string"))
    return rows.mapInArrow(split, f"item {kind}, term binary").distinct()


def bags(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every row: all words with repeats, and the vocabulary's counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.large_binary())
        width = max(len(known), 1)
        for batch in batches:
            n, keys, counts = np.zeros(len(batch), np.int64), [], []
            for at, words, found in _terms(batch.column(1)):
                n[at : at + len(words)] += words
                place = pc.index_in(found, value_set=known)
                hit = pc.is_valid(place).to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(at, at + len(words)), words)[hit]
                key, tf = np.unique(doc * width + place.drop_null().to_numpy(), return_counts=True)
                keys.append(key)
                counts.append(tf)
            key = np.concatenate([np.zeros(0, np.int64), *keys])
            key, back = np.unique(key, return_inverse=True)
            tf = np.zeros(len(key), np.int64)  # a long text's pieces add up
            np.add.at(tf, back, np.concatenate([np.zeros(0, np.int64), *counts]))
            sizes = np.bincount(key // width, minlength=len(batch))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n),
                    list_column((key % width).astype(np.int32), sizes, pa.int32()), list_column(tf, sizes, pa.int64()),
                ],
                ["doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    return rows.mapInArrow(count, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


def classes(kept: DataFrame, top: int) -> DataFrame:
    """``terms, tfs, m, members``: one row for each distinct bag and ``m``.

    ``members`` holds the first ``top`` ids of the class, which are all that can be among an
    item's first ``top`` rows; each task keeps no more of a class before the exchange.
    """
    same = ["key", "m", "terms", "tfs"]
    hashed = kept.withColumn("key", F.xxhash64("terms", "tfs", "m"))
    place = F.row_number().over(Window.partitionBy(*same).orderBy(F.asc_nulls_last("doc_id")))
    first = hashed.withColumn("place", place).filter(F.col("place") <= top)
    listed = F.array_sort(F.collect_list(F.struct("place", "doc_id")))
    return first.groupBy(*same).agg(listed.alias("members")).select("terms", "tfs", "m", F.col("members.doc_id").alias("members"))


class _Best:
    """The best rows of every item so far: score down, id up, rows without an id last."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items)
        self.rows = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]

    def add(self, scores: np.ndarray, member_of: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        """``scores`` by class and item; members by class, in order."""
        least = self.least
        if len(scores) > self.top:
            least = np.maximum(least, np.partition(scores, -self.top, axis=0)[-self.top])
        at, item = np.nonzero(scores >= least)
        first = np.searchsorted(member_of, at)
        sizes = np.searchsorted(member_of, at, "right") - first
        member = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        value = np.repeat(scores[at, item].astype(np.int64), sizes)
        new = [np.repeat(item, sizes), value, missing[member], ids[member]]
        rows = [np.concatenate(x) for x in zip(self.rows, new)]
        order = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
        rows = [x[order] for x in rows]
        place = np.arange(len(order)) - np.searchsorted(rows[0], rows[0])
        full = place == self.top - 1
        self.least[rows[0][full]] = rows[1][full]
        self.rows = [x[place < self.top] for x in rows]


def _scored(found: DataFrame, weights: np.ndarray, of_term: tuple[np.ndarray, np.ndarray], items: int, top: int) -> DataFrame:
    """Each task's best ``item, score, doc_id`` rows; ``of_term`` lists the items of every term."""
    shared = found.sparkSession.sparkContext.broadcast((weights, *of_term))
    rows_at_once = max(1, (1 << 21) // max(items, 1))
    widest = int(np.bincount(of_term[1], minlength=1).max(initial=0)) * int(weights.max(initial=0)) * 1_000_000

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, start, item_of = shared.value
        best = _Best(items, top)
        for whole in batches:
            for k in range(0, len(whole), rows_at_once):
                batch = whole.slice(k, rows_at_once)
                term, tf, member = (batch.column(c).flatten() for c in ("terms", "tfs", "members"))
                sizes, members = (pc.list_value_length(batch.column(c)).to_numpy() for c in ("terms", "members"))
                row = np.repeat(np.arange(len(batch)), sizes)
                term, tf, m = term.to_numpy(), tf.to_numpy(), batch.column("m").to_numpy()[row]
                value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
                each = start[term + 1] - start[term]
                place = np.repeat(start[term] - np.cumsum(each) + each, each) + np.arange(each.sum())
                cell = np.repeat(row * items, each) + item_of[place]
                if widest < 1 << 53:  # sums of whole numbers that doubles hold exactly
                    scores = np.bincount(cell, np.repeat(value, each), len(batch) * items)
                else:
                    scores = np.zeros(len(batch) * items, np.int64)
                    np.add.at(scores, cell, np.repeat(value, each))
                missing = pc.is_null(member).to_numpy(zero_copy_only=False)
                ids = member.fill_null(0).to_numpy()
                best.add(scores.reshape(len(batch), items), np.repeat(np.arange(len(batch)), members), ids, missing)
        item, value, missing, ids = best.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int32)), pa.array(value), pa.array(ids, mask=missing)], ["item_at", "score", "doc_id"]
        )

    return found.mapInArrow(score, "item_at int, score bigint, doc_id bigint")


def search(
    docs: DataFrame, items: DataFrame, how: Search = Search(),
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``item, rank, doc_id, score``: each item's ``top`` documents with a score above 0.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z as a-z.
    Equal scores go by id, rows without an id last. A null or blank text has no word, is in
    no result and does not count among the documents. Rows that share an item id are one
    item, which has the words of them all; a null item id is an id. Every row of ``docs`` is
    a document, so repeated rows are found as often as they stand. No documents or no items
    give an empty result. Other columns are not read.

    Items are searched in blocks of about ``postings`` words, so what a task holds of them
    is bounded; only one item with more words than that makes a larger block.
    """
    spark, scratch = docs.sparkSession, Scratch("bags")
    kind = items.schema[item_col].dataType.simpleString()
    wanted = scratch.write(item_terms(items, item_col, item_text), "item-terms")
    blocks = -(-wanted.count() // how.postings)
    ranked = spark.createDataFrame([], f"item {kind}, rank int, doc_id bigint, score bigint")
    for block in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        ids = sorted({r["item"] for r in rows}, key=lambda x: (x is None, x))
        vocabulary = sorted({bytes(r["term"]) for r in rows})
        at, word = ({v: k for k, v in enumerate(x)} for x in (ids, vocabulary))
        pairs = np.array(sorted((word[bytes(r["term"])], at[r["item"]]) for r in rows), np.int64).reshape(-1, 2)
        start = np.searchsorted(pairs[:, 0], np.arange(len(vocabulary) + 1))

        held = scratch.write(bags(docs, vocabulary, id_col, text_col), f"bags-{block}")
        n_docs, n_terms = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[r["term"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        length = F.expr(f"10 + (90 * n * {n_docs}) div {max(n_terms, 1)}").alias("m")
        kept = held.filter(F.size("terms") > 0).select("doc_id", "terms", "tfs", length)
        best = _scored(classes(kept, how.top), weights, (start, pairs[:, 1]), len(ids), how.top)
        order = Window.partitionBy("item_at").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        first = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= how.top)
        named = spark.createDataFrame([(k, v) for k, v in enumerate(ids)], f"item_at int, item {kind}")
        ranked = ranked.union(first.join(F.broadcast(named), "item_at").select("item", "rank", "doc_id", "score"))
    return ranked
