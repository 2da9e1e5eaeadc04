"""Language-model scoring by cross-entropy difference.

Two bigram models, one of a target within the corpus and one of the whole corpus, share one
vocabulary, one set of pairs, one smoothing and one size, so they differ only in what they
counted. A document's score is the mean over its words of the target model's loss less the
background model's: the lower, the more the document reads like the target.

- The vocabulary is every word that occurs twice or more; all others are one unknown word.
- Every pair of words in every text is counted. A pair that occurs once in the corpus backs
  off to its word, a word to its share of the corpus.
- The corpus is larger than the target, and a larger model predicts better whatever it read.
  So background counts are thinned to the target's size, by a hash of the key.
- A document is scored by what all others count: its own words are taken off both models
  first. So a pair that occurs once in the corpus never helps and is not kept.

Neither the vocabulary nor the pairs have a bound, and no task holds a whole model. Documents
lie in chunks of about ``Shape.chunk`` words. A chunk sends its distinct words, then its distinct
pairs, with their counts to the ranges of keys they fall in; a range adds up what all chunks
sent and answers each chunk with the totals of the keys it asked for. So a chunk is scored
with exactly the part of both models that its own documents touch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsight.llm.packed_counts import Counts, added, blocks, none, pack, summed, twice, unpack
from keepsight.llm.storage import Scratch, drop
from keepsight.llm.words import PIECE, cuts, mix, utf8, word_hashes

BEGIN, UNKNOWN, KNOWN = 0, 1, 2  # numbers of words: before a text, any word that occurs once, the first other one
WORD_RANGES = 1 << 10
SIDE = 1 << 5  # pairs lie in a grid of as many ranges of their first as of their second word
HASHES = 1 << 64


@dataclass(frozen=True)
class Shape:
    """``pair_weight`` is the weight of the word model within the pair model, ``word_weight``
    that of the corpus's shares within the word model. Whole texts of about ``chunk`` words
    together are a chunk, whose pairs a task holds at once; no result depends on it.
    """

    pair_weight: float = 4.0
    word_weight: float = 64.0
    chunk: int = 1 << 20


def numbered(column: pa.Array, vocabulary: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each piece of whole texts: its first text's number, word numbers and word starts.

    A text longer than a piece is read in parts; only its word numbers are held together.
    """
    held: list[np.ndarray] = []
    number = -1
    for a, data, offsets in cuts(*utf8(column)):
        if held and a != number:
            ids = np.concatenate(held)
            yield number, ids, np.array([0, len(ids)])
            held = []
        hashes, first = word_hashes(data, offsets)
        at = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
        known = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
        ids = np.where(known, at + KNOWN, UNKNOWN)
        if len(offsets) == 2:
            held.append(ids)
            number = a
        else:
            yield a, ids, first
    if held:
        ids = np.concatenate(held)
        yield number, ids, np.array([0, len(ids)])


def contexts(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.zeros(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[first[:-1][np.diff(first) > 0]] = BEGIN
    return before


def _uniform(keys: np.ndarray) -> np.ndarray:
    return ((mix(keys) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def thinned(n: np.ndarray, keys: np.ndarray, share: float) -> np.ndarray:
    """How many of ``n`` are left if each stays with chance ``share``: a binomial number drawn by a hash of the key.

    Up to a mean of 30 the distribution is inverted; above, its normal form is rounded.
    """
    n = np.asarray(n, np.float64)
    if share >= 1:
        return n
    keys = keys.astype(np.uint64) + np.uint64(1)
    u, out = _uniform(keys), np.zeros(len(n))
    wide = n * share > 30
    if wide.any():
        v = _uniform(keys[wide] ^ np.uint64(0xD6E8FEB86659FD93))
        normal = np.sqrt(-2 * np.log(u[wide])) * np.cos(2 * np.pi * v)
        mean = n[wide] * share
        out[wide] = np.clip(np.rint(mean + normal * np.sqrt(mean * (1 - share))), 0, n[wide])
    at = np.flatnonzero(~wide & (n > 0))
    chance = np.exp(n[at] * np.log1p(-share))
    below = chance.copy()
    step = 0
    while len(at):
        more = (below < u[at]) & (step < n[at])
        at, chance, below = at[more], chance[more], below[more]
        chance = chance * (n[at] - step) / (step + 1) * (share / (1 - share))
        below = below + chance
        out[at] = step = step + 1
    return out


@dataclass(frozen=True)
class Grid:
    """Keys of pairs of word numbers below ``size``, in ``side`` x ``side`` cells that are ranges of keys.

    So neither the pairs after one frequent word nor those before it fall in one range.
    """

    size: int
    side: int

    @property
    def cell(self) -> int:
        return -(-self.size // self.side)

    @property
    def space(self) -> int:
        return (self.side * self.cell) ** 2

    def parts(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a word adds to a key as the first and as the second of its pair."""
        cell, numbers = self.cell, numbers.astype(np.uint64)
        above, below = numbers // cell, numbers % cell
        return above * (self.side * cell * cell) + below * cell, above * (cell * cell) + below

    def words(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = self.cell
        above, below = keys // (cell * cell), keys % (cell * cell)
        return above // self.side * cell + below // cell, above % self.side * cell + below % cell


@dataclass(frozen=True)
class Totals:
    """Of the whole corpus: the grid of its pairs, its words and the target's."""

    grid: Grid
    corpus: int
    target: int

    @property
    def share(self) -> float:
        return self.target / self.corpus if self.corpus else 0.0


@dataclass
class Models:
    """Both models as far as a chunk's documents touch them.

    ``numbers`` are the sorted numbers of its words, which its texts name by their place there;
    ``pair`` holds the counts of its pairs in the order of their grid keys, 0 for a pair that
    occurs once, ``context`` and ``word`` those by place.
    """

    numbers: np.ndarray
    pair: tuple[np.ndarray, np.ndarray]  # corpus, target
    context: tuple[np.ndarray, np.ndarray]  # corpus (thinned), target
    word: tuple[np.ndarray, np.ndarray]
    totals: Totals
    shape: Shape

    def losses(self, ids: np.ndarray, first: np.ndarray, in_target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean loss of each text under the target model and the background model, both without the text itself."""
        size, share, shape, places = self.totals.grid.size, self.totals.share, self.shape, len(self.numbers)
        total = self.totals.corpus, self.totals.target
        length = np.diff(first)
        text = np.repeat(np.arange(len(length)), length)
        # each text's distinct pairs, with how often it holds the pair, the context and the word itself
        pairs, own = np.unique(text * (places * places) + contexts(ids, first) * places + ids, return_counts=True)
        text, key = pairs // (places * places), pairs % (places * places)
        context, word = key // places, key % places
        before, after = self.totals.grid.parts(self.numbers)
        key = before[context] + after[word]
        _, at = np.unique(key, return_inverse=True)
        corpus, target = (n[at] for n in self.pair)
        kept = corpus > 0
        of_context = _sums(text * places + context, np.where(kept, own, 0))
        of_word = _sums(text * places + word, own)
        number = self.numbers[word]
        key = self.numbers[context] * size + number
        base = ((self.word[0] + 1) / (total[0] + size))[word]

        def loss(pair, of_h, of_w, n):
            share = (of_w + shape.word_weight * base) / (n + shape.word_weight)
            each = own * -np.log((pair + shape.pair_weight * share) / (of_h + shape.pair_weight))
            return np.bincount(text, each, len(length)) / np.maximum(length, 1)

        rest = lambda n, off: np.maximum(n - off, 0)
        good = in_target[text]
        left = rest(target, np.where(kept & good, own, 0))
        of_h = np.maximum(rest(self.context[1][context], of_context * good), left)
        inside = loss(left, of_h, rest(self.word[1][word], of_word * good), rest(total[1], (length * in_target)[text]))
        left = thinned(rest(corpus, np.where(kept, own, 0)), key, share)
        of_h = np.maximum(self.context[0][context] - share * of_context, left)
        of_w = thinned(rest(self.word[0][word], of_word), number + size * size, share)
        return inside, loss(left, of_h, of_w, share * rest(total[0], length[text]))


def _sums(group: np.ndarray, n: np.ndarray) -> np.ndarray:
    _, at = np.unique(group, return_inverse=True)
    return np.bincount(at, n)[at] if len(at) else np.zeros(0)


# Rows of all stages: what a block holds, the chunk it is of or for, its place there, its keys.
ROW = "chunk bigint, kind int, place int, n int, block binary"
CONTEXT, WORD, PAIR, MARK, TEXT, COUNT = range(6)
WHOLE = -1  # in place of a chunk
_ALL, _TARGET, _ALL_UNKNOWN, _TARGET_UNKNOWN = range(4)  # places of counts


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[4] or b"") if schema.names[4] == "block" else 0
        if len(held) == 1024 or size >= PIECE:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


_FIELDS = [("chunk", pa.int64()), ("kind", pa.int32()), ("place", pa.int32()), ("n", pa.int32()), ("block", pa.binary())]


def _blocks(chunk: int, kind: int, counts: Counts, space: int, ranges: int) -> Iterator[tuple]:
    for place, n, block in _rows(blocks(counts, space, ranges)):
        yield chunk, kind, place, n, block


def _starts(lengths: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))])


def _texts(chunk: int, ids: np.ndarray, lengths: list[int], *more: list) -> Iterator[tuple]:
    at = _starts(lengths)
    for k, n in enumerate(lengths):
        yield chunk, TEXT, k, n, _packed(ids[at[k] : at[k + 1]]), *(column[k] for column in more)


def _packed(numbers: np.ndarray) -> bytes:
    return pa.Codec("zstd").compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def _numbers_of(rows: list[tuple]) -> np.ndarray:
    """The numbers of the rows' blocks, one after another."""
    codec, out = pa.Codec("zstd"), [np.zeros(0, np.int64)]
    for row in rows:
        raw = codec.decompress(row[4], decompressed_size=4 * row[3], asbytes=True)
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel())
    return np.concatenate(out).astype(np.int64)


def chunked(limit: int):
    """Rows (id, text) as chunks: each text as places in the chunk's sorted distinct hashes, and these with their counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        chunk = TaskContext.get().partitionId() << 32
        hashes, lengths, ids, words = [], [], [], 0
        for batch in batches:
            last = -1
            for a, data, offsets in cuts(*utf8(batch.column(1))):
                if a != last and words + len(lengths) >= limit:
                    yield from chunk_of(chunk, hashes, lengths, ids)
                    chunk, hashes, lengths, ids, words = chunk + 1, [], [], [], 0
                found, first = word_hashes(data, offsets)
                if a == last:  # the next part of a text longer than a piece
                    lengths[-1] += len(found)
                else:
                    lengths += np.diff(first).tolist()
                    ids += batch.column(0).slice(a, len(offsets) - 1).to_pylist()
                last = a
                hashes.append(found)
                words += len(found)
        if lengths:
            yield from chunk_of(chunk, hashes, lengths, ids)

    def chunk_of(chunk: int, hashes: list[np.ndarray], lengths: list[int], ids: list) -> Iterator[tuple]:
        words, at, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        for row in _blocks(chunk, WORD, (words, n, np.zeros(len(n), np.int64)), HASHES, WORD_RANGES):
            yield *row, None
        yield from _texts(chunk, at, lengths, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*_FIELDS, ("doc_id", batch.schema.field(0).type)])
            yield from _batches(rows(chain([batch], batches)), schema)

    return run


def numbering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range of hashes: the place of every chunk's words among those that occur twice, plus 1; 0 for others."""

    def rows() -> Iterator[tuple]:
        for place, sent in groupby(_rows(batches), itemgetter(2)):
            sent = list(sent)
            found = summed(unpack(block, n) for *_, n, block in sent)
            known = twice(found)[0]
            yield WHOLE, COUNT, place, len(known), None
            for chunk, _, _, n, block in sent:
                keys = unpack(block, n)[0]
                at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
                at = np.where(known[at] == keys, at + 1, 0) if len(known) else np.zeros(n, np.int64)
                yield chunk, WORD, place, n, _packed(at)

    yield from _batches(rows(), pa.schema(_FIELDS))


def paired(starts: np.ndarray, grid: Grid):
    """For each chunk: its words' and pairs' counts by number, its texts as places in its sorted numbers.

    ``starts`` are the vocabulary's words before each range of hashes.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for chunk, sent in groupby(_rows(batches), itemgetter(0)):
            of = {kind: list(x) for kind, x in groupby(sent, itemgetter(1))}
            texts, replies = of[TEXT], of.get(WORD, [])
            at, n = _numbers_of(replies), [row[3] for row in replies]
            start = np.repeat(starts[[row[2] for row in replies]] if replies else starts[:0], n)
            numbers = np.where(at > 0, start + at - 1 + KNOWN, UNKNOWN)
            numbers, place = np.unique(np.concatenate([[BEGIN, UNKNOWN], numbers]), return_inverse=True)
            ids = place[2:][_numbers_of(texts)]
            lengths = [row[3] for row in texts]
            first = _starts(lengths)
            flags = np.zeros(len(texts), bool)
            flags[[row[2] for row in of.get(MARK, [])]] = True
            good = np.repeat(flags, lengths).astype(np.int64)
            before, after = grid.parts(numbers)
            keys = before[contexts(ids, first)] + after[ids]
            word = (numbers.astype(np.uint64), *(np.bincount(ids, n, len(numbers)).astype(np.int64) for n in (None, good)))
            for row in _blocks(chunk, PAIR, added([(keys, np.ones(len(keys), np.int64), good)]), grid.space, grid.side**2):
                yield *row, None, None
            for row in _blocks(chunk, WORD, word, grid.size, WORD_RANGES):
                yield *row, None, None
            for place, n in enumerate((len(ids), good.sum(), word[1][UNKNOWN], word[2][UNKNOWN])):
                yield chunk, COUNT, place, int(n), None, None, None
            yield from _texts(chunk, ids, lengths, [row[5] for row in texts], flags.tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*_FIELDS, ("doc_id", batch.schema.field(5).type), ("in_target", pa.bool_())])
            yield from _batches(rows(chain([batch], batches)), schema)

    return run


def _of(counts: Counts, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both counts of each of ``keys``, 0 if there are none."""
    if not len(counts[0]):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(counts[0], keys), len(counts[0]) - 1)
    hit = counts[0][at] == keys
    return np.where(hit, counts[1][at], 0), np.where(hit, counts[2][at], 0)


def pair_replies(totals: Totals):
    """For each range of pairs: the counts of each chunk's pairs in their order, 0 if they occur once, and sums by context."""
    grid = totals.grid

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for place, sent in groupby(_rows(batches), itemgetter(2)):
            sent = list(sent)
            keys, corpus, target = twice(summed(unpack(block, n) for *_, n, block in sent))
            context, word = grid.words(keys)
            thin = thinned(corpus, context * np.uint64(grid.size) + word, totals.share).astype(np.int64)
            yield from _blocks(WHOLE, CONTEXT, added([(context, thin, target)]), grid.size, WORD_RANGES)
            for chunk, _, _, n, block in sent:
                yield chunk, PAIR, place, n, pack((np.zeros(n, np.uint64), *_of((keys, corpus, target), unpack(block, n)[0])))

    return lambda batches: _batches(rows(batches), pa.schema(_FIELDS))


def word_replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range of word numbers: the counts of each chunk's words as words and as contexts."""

    def rows() -> Iterator[tuple]:
        for place, sent in groupby(_rows(batches), itemgetter(2)):
            of = {kind: list(x) for kind, x in groupby(sent, itemgetter(1))}
            asking = of.get(WORD, [])
            for kind in (CONTEXT, WORD):
                found = summed(unpack(block, n) for *_, n, block in of.get(kind, []))
                found = twice(found) if kind == WORD else found
                for chunk, _, _, n, block in asking:
                    asked = unpack(block, n)[0]
                    yield chunk, kind, place, n, pack((asked, *_of(found, asked)))

    yield from _batches(rows(), pa.schema(_FIELDS))


def scored(totals: Totals, shape: Shape):
    """For each chunk: both losses of its texts, from the totals of its words and pairs."""

    def part(rows: list[tuple]) -> Counts:
        return tuple(np.concatenate(x) for x in zip(none(), *(unpack(row[4], row[3]) for row in rows)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, sent in groupby(_rows(batches), itemgetter(0)):
            of = {kind: list(x) for kind, x in groupby(sent, itemgetter(1))}
            context, word, pair = (part(of.get(kind, [])) for kind in (CONTEXT, WORD, PAIR))
            models = Models(word[0].astype(np.int64), pair[1:], context[1:], word[1:], totals, shape)
            lengths, flags = [row[3] for row in of[TEXT]], [row[6] for row in of[TEXT]]
            found = models.losses(_numbers_of(of[TEXT]), _starts(lengths), np.array(flags))
            for row, inside, background in zip(of[TEXT], *(x.tolist() for x in found)):
                yield row[5], row[3], row[6], *((inside, background) if row[3] else (None, None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [("doc_id", batch.schema.field(5).type), ("n_words", pa.int64()), ("in_target", pa.bool_())]
            fields += [("target_loss", pa.float64()), ("background_loss", pa.float64())]
            yield from _batches(rows(chain([batch], batches)), pa.schema(fields))

    return run


def _dealt(rows: DataFrame, by: str, *order: str) -> DataFrame:
    return rows.repartition(by).sortWithinPartitions(by, *order)


def fitted(rows: DataFrame, target: DataFrame, chunk: int) -> tuple[DataFrame, Totals]:
    """Both models, from all of ``rows`` (doc_id, text); the target is the rows with an id in ``target``.

    Returned are the chunks' texts with the counts of all their words and pairs that occur twice.
    """
    scratch, spark, kind = Scratch("crossentropy"), rows.sparkSession, rows.schema["doc_id"].dataType.simpleString()
    texts, path = scratch.located(rows.mapInArrow(chunked(chunk), f"{ROW}, doc_id {kind}"), "chunks")
    written = [path]
    words = texts.filter(F.col("kind") == WORD).drop("doc_id")
    words, path = scratch.located(_dealt(words, "place").mapInArrow(numbering, ROW), "words")
    written.append(path)
    known = np.zeros(WORD_RANGES + 1, np.int64)
    for row in words.filter(F.col("chunk") == WHOLE).collect():
        known[row["place"] + 1] = row["n"]
    starts = np.cumsum(known)
    texts = texts.filter(F.col("kind") == TEXT)
    chunks = texts.filter("place = 0").count()
    grid = Grid(int(starts[-1]) + KNOWN, max(SIDE, int((chunks / 8) ** 0.5)))

    marks = texts.select("chunk", "place", "doc_id").join(target.select("doc_id").hint("merge"), "doc_id", "left_semi")
    marks = marks.select("chunk", F.lit(MARK).alias("kind"), "place")
    sent = words.filter(F.col("chunk") != WHOLE)
    sent = sent.unionByName(marks, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    sent = _dealt(sent, "chunk", "kind", "place")
    sent, _ = scratch.located(sent.mapInArrow(paired(starts, grid), f"{ROW}, doc_id {kind}, in_target boolean"), "pairs")
    for path in written:
        drop(spark, path)
    counts = dict(sent.filter(F.col("kind") == COUNT).groupBy("place").agg(F.sum("n")).collect())
    alone = [counts.get(k, 0) if counts.get(_ALL_UNKNOWN) == 1 else 0 for k in (_ALL_UNKNOWN, _TARGET_UNKNOWN)]
    totals = Totals(grid, counts.get(_ALL, 0) - alone[0], counts.get(_TARGET, 0) - alone[1])

    plain = sent.drop("doc_id", "in_target")
    pairs = _dealt(plain.filter(F.col("kind") == PAIR), "place").mapInArrow(pair_replies(totals), ROW)
    pairs, _ = scratch.located(pairs, "replies")
    by_word = pairs.filter(F.col("kind") == CONTEXT).unionAll(plain.filter(F.col("kind") == WORD))
    by_word = _dealt(by_word, "place", "kind").mapInArrow(word_replies, ROW)
    replies = by_word.unionAll(pairs.filter(F.col("kind") == PAIR))
    return replies.unionByName(sent.filter(F.col("kind") == TEXT), allowMissingColumns=True), totals


def cross_entropy_difference(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape = Shape()
) -> DataFrame:
    """``doc_id, n_words, in_target, target_loss, background_loss, score`` of every row of ``docs``.

    ``target`` lists in ``id_col`` the ids of the rows that make up the target; a null id is
    never in it, repeated ids count once, ids that ``docs`` lacks do nothing. Losses are nats
    a word. A null or blank text has no word; its losses and score are null. Repeated rows
    count and are scored each time, each against the others. Without a target both models
    fall back to the corpus's shares and all scores are 0. An empty ``docs`` gives an empty
    result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = target.select(F.col(id_col).alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    parts, totals = fitted(rows, ids, shape.chunk)
    kind = docs.schema[id_col].dataType.simpleString()
    losses = f"doc_id {kind}, n_words bigint, in_target boolean, target_loss double, background_loss double"
    found = _dealt(parts, "chunk", "kind", "place").mapInArrow(scored(totals, shape), losses)
    return found.withColumn("score", F.col("target_loss") - F.col("background_loss"))
