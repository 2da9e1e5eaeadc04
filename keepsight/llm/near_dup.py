"""Near duplicates: MinHash bands, sequential Bayesian pruning, exact verification.

A document is the set of its distinct word shingles. Documents with equal sets are one
class and only a class's representative is compared. Representatives that share a band
of their MinHash signature are candidates. A candidate's signatures are compared a batch
at a time; after each batch, the posterior of the similarity says how likely it still is
to reach the threshold, and the pair is given up once that chance is below a chosen miss
probability. What survives is verified on the full sets.

Groups of any size: in turns, every member whose bands hold several components is compared
with one hub, a member of the largest of them, and the links found are contracted; so a
turn costs no more than one pair a document, and each turn leaves fewer. Only members that
hubs keep leaving in different components are compared with the rest of their band, in
blocks: signatures first, then whole sets of those that a likely partner is left for. What
leaves a block is no pair of sets but a star for each component in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsight.llm import bitmap as bitmaps
from keepsight.llm.components import components, contracted
from keepsight.llm.storage import Scratch, drop
from keepsight.llm.words import hashed_texts, list_column, mix, windows


@dataclass(frozen=True)
class NearDup:
    """``shingle`` words, ``threshold`` of the Jaccard similarity in percent, ``rows`` of a
    band, the chance ``band_miss`` that a pair at the threshold shares no band, the chance
    ``miss`` at which a comparison is given up, hashes compared in a ``batch``, members of a
    ``block`` and the ``shingles`` that they have at most together; hubs go on for
    ``turns`` at most, while one in ``worth`` of the likely pairs is a link."""

    shingle: int = 5
    threshold: int = 80
    rows: int = 5
    band_miss: float = 1e-6
    miss: float = 1e-5
    batch: int = 20
    block: int = 1024
    shingles: int = 1 << 20
    worth: int = 8
    turns: int = 16

    @cached_property
    def bands(self) -> int:
        return math.ceil(math.log(self.band_miss) / math.log(1 - (self.threshold / 100) ** self.rows))

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @cached_property
    def least_matches(self) -> list[tuple[int, int]]:
        """(hashes compared, matches needed to go on), batch by batch.

        With a uniform prior the similarity after m matches of n is Beta(m + 1, n - m + 1);
        P(similarity >= t) is then the chance of at most m successes in n + 1 trials at t.
        """
        t, out = self.threshold / 100, []
        for n in [*range(self.batch, self.hashes, self.batch), self.hashes]:
            below, least = 0.0, 0
            for m in range(n + 2):
                below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
                if below >= self.miss:
                    least = m
                    break
            out.append((n, least))
        return out


def _keys(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(0, 1 << 32, k, dtype=np.uint32), rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each piece of a text column: distinct shingle hashes of its texts, and their counts.

    A text of fewer words than ``size`` has its whole sequence as one shingle.
    """
    for _, hashes, first in hashed_texts(column):
        runs, sets = windows(hashes, size), []
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= size:
                sets.append(np.unique(runs[a : b - size + 1]))
            elif b > a:
                sets.append(mix(windows(hashes[a:b], b - a) + np.uint64(b - a)))
            else:
                sets.append(hashes[:0])
        yield np.concatenate(sets) if sets else hashes[:0], np.array([len(s) for s in sets])


def minhashes(values: np.ndarray, counts: np.ndarray, hashes: int) -> np.ndarray:
    """The signature of each set, a row of 32-bit minima; sets must not be empty."""
    flips, factors = _keys(hashes)
    out = np.empty((len(counts), hashes), np.uint32)
    folded = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    ends = np.cumsum(counts)
    first = 0
    while first < len(counts):  # in runs that stay in the processor's cache
        start = ends[first] - counts[first]
        last = max(int(np.searchsorted(ends, start + 32_768, "right")), first + 1)
        part, at = folded[start : ends[last - 1]], ends[first:last] - counts[first:last] - start
        work = np.empty_like(part)
        for k in range(hashes):
            np.bitwise_xor(part, flips[k], out=work)
            np.multiply(work, factors[k], out=work)
            out[first:last, k] = np.minimum.reduceat(work, at)
        first = last
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of every band of every signature; bands never share keys by position."""
    n, k = signatures.shape
    parts = signatures.reshape(n, k // rows, rows).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, k // rows + 1, dtype=np.uint64)), (n, k // rows)).copy()
    for r in range(rows):
        key = mix(key + parts[:, :, r] * np.uint64(0x9E3779B97F4A7C15))
    return key


def signatures(docs: DataFrame, id_col: str, text_col: str, how: NearDup) -> DataFrame:
    """``doc_id, n_shingles, node, sig, bands`` of every row; no words: null node, sig and bands.

    ``node`` is a 128-bit fingerprint of the set, ``sig`` holds 16 bits of each minimum.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for values, counts in shingle_sets(batch.column(1), how.shingle):
                ids = batch.column(0).slice(at, len(counts))
                at += len(counts)
                full = np.flatnonzero(counts)
                node = np.full(len(counts), None, object)
                sig = np.full(len(counts), None, object)
                lengths = np.zeros(len(counts), np.int64)
                keys = np.zeros((0, how.bands), np.uint64)
                if len(full):
                    starts = (np.cumsum(counts) - counts)[full]
                    prints = np.stack(
                        [mix(np.add.reduceat(mix(values + np.uint64(s)), starts)) for s in (11, 47)], 1
                    )
                    node[full] = [p.tobytes() for p in prints]
                    minima = minhashes(values, counts[full], how.hashes)
                    keys = band_keys(minima, how.rows)
                    sig[full] = [s.tobytes() for s in (minima >> np.uint32(16)).astype(np.uint16)]
                    lengths[full] = how.bands
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(counts, pa.int64()),
                        pa.array(node, pa.binary()),
                        pa.array(sig, pa.binary()),
                        list_column(keys.ravel().astype(np.int64), lengths, pa.int64()),
                    ],
                    ["doc_id", "n_shingles", "node", "sig", "bands"],
                )

    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col))
    return rows.mapInArrow(sign, "doc_id bigint, n_shingles bigint, node binary, sig binary, bands array<bigint>")


def likely(pairs: DataFrame, reps: DataFrame, how: NearDup) -> DataFrame:
    """The pairs ``a, b`` whose signatures survive sequential comparison, with their ``matches``."""
    sig = reps.select("id", "sig")
    both = pairs.join(sig.withColumnsRenamed({"id": "a", "sig": "sig_a"}), "a").join(
        sig.withColumnsRenamed({"id": "b", "sig": "sig_b"}), "b"
    )
    steps, width = how.least_matches, how.hashes

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("sig_a", "sig_b"):
                column = batch.column(name)
                sides.append(np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(batch), width))
            alive, matches = surviving(*sides, steps)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n).take(pa.array(alive)) for n in ("a", "b")] + [pa.array(matches, pa.int32())],
                ["a", "b", "matches"],
            )

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(compare, "a bigint, b bigint, matches int")


def surviving(left: np.ndarray, right: np.ndarray, steps) -> tuple[np.ndarray, np.ndarray]:
    """Rows that no batch of hashes rules out, and their matches."""
    alive = np.arange(len(left))
    matches, done = np.zeros(len(left), np.int32), 0
    for n, least in steps:
        matches = matches + (left[alive, done:n] == right[alive, done:n]).sum(1, dtype=np.int32)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], n
    return alive, matches


def _filter_bits(ids: int) -> int:
    """Bits of a filter over so many ids: 16 for each, 128 MB at most; a fuller filter only lets more through."""
    return 1 << min(30, max(16, (16 * ids - 1).bit_length()))


def _sets_of(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str, how: NearDup) -> DataFrame:
    """``id, shingles`` of the documents whose ids are in ``needed``.

    A bitmap of the ids' hashes spares the other texts the shuffle; the join that follows
    is what decides.
    """
    spark, bits = docs.sparkSession, _filter_bits(needed.count())
    bitmap = bitmaps.build(needed.select(F.xxhash64("id").alias("key")), "key", bits)
    shared = spark.sparkContext.broadcast(bitmap)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = shared.value
        for batch in batches:
            batch = batch.filter(pa.array(bitmaps.holds(marked, batch.column(2).to_numpy())))
            at = 0
            for values, counts in shingle_sets(batch.column(1), how.shingle):
                ids = batch.column(0).slice(at, len(counts))
                at += len(counts)
                yield pa.RecordBatch.from_arrays(
                    [ids, list_column(values.astype(np.int64), counts, pa.int64())], ["id", "shingles"]
                )

    ident = F.col(id_col).cast("bigint")
    rows = docs.select(ident.alias("id"), text_col, bitmaps.place(F.xxhash64(ident), bits).alias("p"))
    found = rows.filter("id IS NOT NULL").mapInArrow(collect, "id bigint, shingles array<bigint>")
    return found.join(needed.select("id"), "id", "left_semi")


def _links(pairs: DataFrame, sets: DataFrame, how: NearDup) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_a"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("_b"))
    threshold = how.threshold

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (av, ao), (bv, bo) = (_lists(batch.column(n)) for n in ("_a", "_b"))
            keep = np.zeros(len(batch), bool)
            for k in range(len(batch)):
                x, y = av[ao[k] : ao[k + 1]], bv[bo[k] : bo[k + 1]]
                both = np.intersect1d(x, y, assume_unique=True).size
                keep[k] = 100 * both >= threshold * (x.size + y.size - both)
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "_a", "_b").mapInArrow(verify, "a bigint, b bigint")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return column.values.to_numpy(zero_copy_only=False), offsets


def _mixed_bands(members: DataFrame, found: DataFrame, turn: int) -> DataFrame:
    """``key, id, comp, hub, hub_comp`` of the members (``key, id``) of bands with several components.

    A band's hub is a member of its largest component, another one each turn. ``found`` has
    the ``id, comp`` of who is linked; another document is its own component.
    """
    here = members.join(found, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    each = here.groupBy("key", "comp").agg(F.count("*").alias("n"), F.min(_drawn("id", turn)).alias("hub"))
    hubs = each.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("n", "hub", "comp")).alias("top"))
    hubs = hubs.filter("parts > 1").select("key", F.col("top.hub.id").alias("hub"), F.col("top.comp").alias("hub_comp"))
    return here.join(hubs, "key").select("key", "id", "comp", "hub", "hub_comp")


def _drawn(column: str, turn: int):
    return F.struct(F.xxhash64(F.col(column), F.lit(turn)).alias("by"), F.col(column).alias("id"))


def _one_hub_each(mixed: DataFrame, turn: int) -> DataFrame:
    """``id, met``: each member outside a hub's component, and the one of its bands' hubs
    that all would choose."""
    met = mixed.filter("comp <> hub_comp").groupBy("id").agg(F.min(_drawn("hub", turn)).alias("hub"))
    return met.select("id", F.col("hub.id").alias("met"))


def _within_bands(members: DataFrame, how: NearDup, exact: bool) -> DataFrame:
    """Compares members (``key, id, comp, sig, met``; if ``exact`` also ``shingles``) of one band
    and different components, but for the pairs that have ``met`` before.

    Who is not in a band's largest component is compared with the others. Both sides are
    cut into blocks by members and shingles, and each pair of blocks is one group, compared
    as arrays; so a band costs its other members times its blocks. Signatures prune first.
    Not ``exact``: gives the ``key, id`` that a likely partner is left for. ``exact``:
    verifies those pairs on the full sets and gives ``a, b``, a star for each component
    that a group's links make. Either way a group gives no more rows than it has. With a
    column ``keys``, the bands that each member is left in, a pair counts in the first band
    that both are left in and in no other.
    """
    size = F.size("shingles") if exact else F.lit(0)
    each = members.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum(size).alias("size"))
    bands = each.groupBy("key").agg(
        F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "size", "comp")).alias("top")
    )
    blocks = lambda n, size: F.ceil(F.greatest(n / how.block, size / how.shingles)).cast("int")
    bands = bands.filter("top.n < n").select(
        "key", F.col("top.comp").alias("top"), blocks(F.col("n"), F.col("size")).alias("rights"),
        blocks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("lefts"),
    )
    mixed = members.join(bands, "key").withColumn("other", F.col("comp") != F.col("top"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = ["id", "comp", "other", "sig", "met", *(c for c in ("keys", "shingles") if c in members.columns)]
    left = mixed.filter("other").select("key", own("lefts").alias("i"), copies("rights").alias("j"), F.lit(True).alias("left"), *held)
    right = mixed.select("key", copies("lefts").alias("i"), own("rights").alias("j"), F.lit(False).alias("left"), *held)
    found = (lambda table: _linked(table, how)) if exact else (lambda table: _likely(table, how))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if kept is None else [kept, batch]).combine_chunks()
            whole = int(_group_starts(table)[-1]) if len(table) else 0  # the last group may go on in the next batch
            if whole:
                yield found(table.slice(0, whole).to_batches()[0])
            kept = next(iter(table.slice(whole).to_batches()), None)
        if kept is not None:
            yield found(kept)

    group = ["key", "i", "j"]
    dealt = left.union(right).repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(compare, "a bigint, b bigint" if exact else "key bigint, id bigint").distinct()


def _group_starts(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Where the rows of each (key, i, j) start."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for name in ("key", "i", "j"):
        value = table.column(name).to_numpy()
        new[1:] |= value[1:] != value[:-1]
    return np.flatnonzero(new)


def _survivors(batch: pa.RecordBatch, how: NearDup) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each piece of each group, the group's first row and the rows of the likely pairs."""
    ids, comps, other, left = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("id", "comp", "other", "left"))
    sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(len(batch), how.hashes)
    met = np.repeat(ids[:, None], how.turns, 1)  # nobody meets itself, so the own id stands for none
    hubs, offsets = _lists(batch.column("met").fill_null([]))
    row = np.repeat(np.arange(len(batch)), np.diff(offsets))
    met[row, np.arange(offsets[0], offsets[-1]) - offsets[row]] = hubs[offsets[0] : offsets[-1]]
    key = batch.column("key").to_numpy()
    keys = _lists(batch.column("keys")) if "keys" in batch.schema.names else None
    starts = _group_starts(batch)
    for low, high in zip(starts, np.append(starts[1:], len(batch))):
        before = _earlier_bands(*keys, low, high, key[low]) if keys else None
        lefts, rights = (low + np.flatnonzero(left[low:high] == side) for side in (True, False))
        step = max(1, (1 << 18) // max(1, len(rights)))
        for k in range(0, len(lefts), step):
            x = np.repeat(lefts[k : k + step], len(rights))
            y = np.tile(rights, len(lefts[k : k + step]))
            meet = (comps[x] != comps[y]) & (~other[y] | (ids[x] < ids[y]))  # two others meet twice
            x, y = x[meet], y[meet]
            alive, _ = surviving(sig[x], sig[y], how.least_matches)
            x, y = x[alive], y[alive]
            new = ~((met[x] == ids[y][:, None]).any(1) | (met[y] == ids[x][:, None]).any(1))
            x, y = x[new], y[new]
            if before is not None and before.shape[1]:
                first = np.ones(len(x), bool)
                for column in range(before.shape[1]):
                    code = before[x - low, column][:, None]
                    first &= ~((code >= 0) & (code == before[y - low])).any(1)
                x, y = x[first], y[first]
            if len(x):
                yield low, x, y


def _earlier_bands(keys: np.ndarray, offsets: np.ndarray, low: int, high: int, key: int) -> np.ndarray:
    """For rows ``low`` to ``high``, numbers of the bands below ``key`` that several of them are in, filled up with -1."""
    part = keys[offsets[low] : offsets[high]]
    row = np.repeat(np.arange(high - low), np.diff(offsets[low : high + 1]))
    part, row = part[part < key], row[part < key]
    _, code, often = np.unique(part, return_inverse=True, return_counts=True)
    several = often[code] > 1
    code, row = code[several], row[several]
    counts = np.bincount(row, minlength=high - low)
    out = np.full((high - low, int(counts.max(initial=0))), -1, np.int64)
    out[row, np.arange(len(row)) - (np.cumsum(counts) - counts)[row]] = code
    return out


def _likely(batch: pa.RecordBatch, how: NearDup) -> pa.RecordBatch:
    """The rows, as ``key, id``, of which a likely pair is left."""
    rows = [np.zeros(0, np.int64)]
    for _, x, y in _survivors(batch, how):
        rows += [np.unique(x), np.unique(y)]
    return batch.select(["key", "id"]).take(pa.array(np.unique(np.concatenate(rows))))


def _linked(batch: pa.RecordBatch, how: NearDup) -> pa.RecordBatch:
    """For each group, ``a, b``: every row that verified links reach, with the first row they reach it from."""
    values, offsets = _lists(batch.column("shingles"))
    up = np.arange(len(batch))
    for low, x, y in _survivors(batch, how):
        keep = _reach(x, y, values, offsets, how.threshold)
        x, y = x[keep], y[keep]
        while True:  # the least row around, until both ends of every link have the same
            least = np.minimum(up[x], up[y])
            if (up[x] == least).all() and (up[y] == least).all():
                break
            for end in (x, y):
                np.minimum.at(up, up[end], least)
                np.minimum.at(up, end, least)
            up = up[up]
    up = up[up]
    rows = np.flatnonzero(up != np.arange(len(batch)))
    ids = batch.column("id").to_numpy()
    return pa.RecordBatch.from_arrays([pa.array(ids[up[rows]]), pa.array(ids[rows])], ["a", "b"])


def _reach(x: np.ndarray, y: np.ndarray, values: np.ndarray, offsets: np.ndarray, threshold: int) -> np.ndarray:
    """Which pairs of sets reach the threshold: common members counted by products of 0/1 matrices."""
    (rows_x, at_x), (rows_y, at_y) = (np.unique(side, return_inverse=True) for side in (x, y))
    size = np.diff(offsets)
    rows = np.union1d(rows_x, rows_y)
    held = np.concatenate([values[offsets[r] : offsets[r + 1]] for r in rows])
    _, column, often = np.unique(held, return_inverse=True, return_counts=True)
    common = np.flatnonzero(often > 1)
    place = np.full(len(often), -1)
    place[common] = np.arange(len(common))
    column, row = place[column], np.repeat(np.arange(len(rows)), size[rows])
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros(len(x), np.int64)
    of_x, of_y = np.searchsorted(rows, rows_x), np.searchsorted(rows, rows_y)
    for k in range(0, len(common), 2048):
        a, b = np.searchsorted(column, (k, k + 2048))
        holds = np.zeros((len(rows), min(2048, len(common) - k)), np.float32)
        holds[row[a:b], column[a:b] - k] = 1
        both += (holds[of_x] @ holds[of_y].T)[at_x, at_y].astype(np.int64)  # below 2^24, so exact
    return 100 * both >= threshold * (size[x] + size[y] - both)


def near_duplicates(
    docs: DataFrame, how: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    ``component_id`` is the least id of the documents reached over links, the document
    itself included; ``kept`` is true for that one. Words are what lies between ASCII white
    space, A-Z as a-z. A text without words, or null, has no shingle and no link. Rows that
    share an id are one document: linked with whatever any of them is linked with. A row
    without an id belongs to the component of documents with its set, if any, and is then
    not kept; else its component is null and it is kept. Ids must be whole numbers. An
    empty table gives an empty result; other columns are not read.
    """
    scratch, spark = Scratch("neardup"), docs.sparkSession
    signed = scratch.write(signatures(docs, id_col, text_col, how), "signed")
    reps, reps_at = scratch.located(
        signed.filter("node IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("node")
        .agg(F.min("doc_id").alias("id"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands")),
        "reps",
    )
    keyed = reps.select("id", F.explode("bands").alias("key"))
    several = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    members, members_at = scratch.located(keyed.join(several, "key"), "members")
    ends = lambda pairs: pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b"))).distinct()

    sets = None
    links = members.filter("false").select(F.col("id").alias("a"), F.col("id").alias("b"))

    def add_sets(needed: DataFrame, turn: str) -> None:
        """A document's set is taken from its text once."""
        nonlocal sets
        fresh = needed if sets is None else needed.join(sets.select("id"), "id", "left_anti")
        fresh = scratch.write(fresh, f"needed-{turn}")
        if sets is None or not fresh.isEmpty():
            more = scratch.write(_sets_of(docs, fresh, id_col, text_col, how), f"sets-{turn}")
            sets = more if sets is None else sets.union(more)

    turn, left, met = 0, members, None
    while True:  # hubs: as long as one in `worth` of a turn's likely pairs is a link; blocks do the rest
        found = links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("comp"))
        left = scratch.write(_mixed_bands(left.select("key", "id"), found, turn), f"mixed-{turn}")
        chosen = _one_hub_each(left, turn)
        pairs = chosen.select(F.least("id", "met").alias("a"), F.greatest("id", "met").alias("b")).distinct()
        near = scratch.write(likely(pairs, reps, how), f"likely-{turn}")
        met = chosen if met is None else met.union(chosen)
        n_near = near.count()
        if n_near:
            add_sets(ends(near), str(turn))
            new = scratch.write(_links(near, sets, how), f"links-{turn}")
            links = scratch.write(contracted(links.union(new)), f"contracted-{turn}")
        turn += 1
        if not n_near or turn == how.turns or how.worth * new.count() < n_near:
            break

    # members whom their hubs have left in different components
    found = links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("comp"))
    left = _mixed_bands(left.select("key", "id"), found, turn).select("key", "id", "comp")
    met = met.groupBy("id").agg(F.collect_set("met").alias("met"))  # one for each turn at most
    left = scratch.write(left.join(reps.select("id", "sig"), "id").join(met, "id", "left"), "left")
    left = scratch.write(left.join(_within_bands(left, how, False), ["key", "id"]), "likely-left")
    if not left.isEmpty():
        # sets are dealt only to the first band of each likely pair
        keys = left.groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
        left = scratch.write(left.join(keys, "id"), "likely-keys")
        left = scratch.write(left.join(_within_bands(left, how, False), ["key", "id"]), "likely-first")
        add_sets(left.select("id").distinct(), "left")
        links = links.union(scratch.write(_within_bands(left.join(sets, "id"), how, True), "links-left"))
    found = components(links, scratch)
    classes = reps.select("node", "id").join(found, "id", "left").select("node", F.coalesce("comp", "id").alias("component_id"))
    classes = scratch.write(classes, "classes")
    for path in (members_at, reps_at):
        drop(docs.sparkSession, path)
    rows = signed.select("doc_id", "n_shingles", "node").join(classes, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def distinct_documents(
    docs: DataFrame, how: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without the documents of a component other than its first; columns stay as they are.

    Rows that share an id stay or go together, so repeated rows stay repeated.
    """
    gone = near_duplicates(docs, how, id_col, text_col).filter("NOT kept AND doc_id IS NOT NULL")
    gone = gone.select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("bigint") == F.col("_gone"), "left_anti")
