"""A trie of conversations, grouped by blocks of turns first.

Every turn is a digest with its place; a prefix's digest is the exclusive or of its turns',
so it is the same whichever way it was put together. Conversations are first grouped by
the digests up to the end of each block of ``BLOCK`` turns, one row for each conversation
and block. A group whose members all go through the next block together needs no look
inside it: one member gives its nodes. Only where siblings part within a block are turn
boundaries grouped, and there each distinct block stands once, with its number of members.

Sums over subtrees follow paths. A node belongs to the path of that member whose hashed id
is least, so a node's path goes on into one child, and from a leaf to the root the path
changes about as often as the logarithm of the members. Paths hand their sums to the path
they hang on, one round for each such change.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsight.llm.order import ranked
from keepsight.llm.storage import Scratch

BLOCK = 4
#: Rows that one window of a running fold takes; more make further chunks.
CHUNK = 4096
#: Ids that one piece of a list of ids holds.
IDS = 1 << 15

WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "t1", "t2"]
PARENT = ["depth", "q1", "q2"]


def running(df: DataFrame, key: str, place: str, columns: list[str], fold, both) -> DataFrame:
    """``df`` with each of ``columns`` folded over its key's rows up to the own ``place``.

    Windows span ``CHUNK`` places of a key; what the chunks before come to is one row for
    each chunk. ``both`` joins two folded values.
    """
    cut = df.withColumn("_chunk", F.floor(F.col(place) / CHUNK))
    inner = Window.partitionBy(key, "_chunk").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(key, "_chunk").agg(*(fold(c).alias(c) for c in columns))
    carried = sums.select(key, "_chunk", *(fold(c).over(before).alias(f"_{c}") for c in columns))
    carried = carried.filter(F.col(f"_{columns[0]}").isNotNull())  # chunks that others of the key precede
    folded = cut.withColumns({c: fold(c).over(inner) for c in columns}).join(carried, [key, "_chunk"], "left")
    for c in columns:
        folded = folded.withColumn(c, F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(both(F.col(c), F.col(f"_{c}"))))
    return folded.drop("_chunk", *(f"_{c}" for c in columns))


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def forks(conversations: DataFrame, scratch: Scratch, apart: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' ids (``c, turns``) and turns (``c, pos, digest, words``).

    Conversation ``c`` starts with the first h turns of conversation ``c - c % apart`` and
    goes on with its own after its first h; h is the crc32 of its decimal id modulo ``heads``.
    """
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("c"), F.col("turn"), F.unhex(F.sha2(named, 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    ).filter("c IS NOT NULL")
    turns = ranked(turns, ["c", "turn", "digest"], scratch, "turns")
    own = turns.groupBy("c").agg(F.min("rank").alias("first"), F.count("*").alias("own"))
    convs = own.withColumns(
        {"h": F.crc32(F.col("c").cast("string")) % heads, "p": F.col("c") - F.col("c") % apart}
    )
    parents = own.select(F.col("c").alias("p"), F.col("own").alias("there"))
    convs = convs.join(parents, "p", "left").withColumn("lent", F.least("h", F.coalesce("there", F.lit(0))))
    convs = scratch.write(convs.withColumn("turns", F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "convs")
    placed = turns.join(convs, "c").withColumn("at", F.col("rank") - F.col("first"))
    kept = placed.filter("at >= h").select("c", (F.col("at") - F.col("h") + F.col("lent")).alias("pos"), "digest", "words")
    early = placed.filter(F.col("at") < heads - 1).select(F.col("c").alias("p"), "at", "digest", "words")
    lent = convs.select("c", "p", "lent").join(early, "p").filter("at < lent")
    rebuilt = kept.union(lent.select("c", F.col("at").alias("pos"), "digest", "words"))
    return convs.select("c", "turns"), scratch.write(rebuilt, "rebuilt")


def _nodes(convs: DataFrame, turns: DataFrame, root, scratch: Scratch, block: int) -> tuple[DataFrame, DataFrame]:
    """All nodes (``depth, t1, t2, q1, q2, conv_id, via, n_convs, words``), and where each conversation ends."""
    x = {f"x{k}": F.xxhash64(F.lit(k), "pos", "digest") for k in (1, 2)}
    cut = turns.withColumns(x | {"k": F.floor(F.col("pos") / block)})
    blocks = cut.groupBy("c", "k").agg(
        F.count("*").alias("size"), *(F.bit_xor(f"x{i}").alias(f"b{i}") for i in (1, 2)), *(F.bit_xor(f"x{i}").alias(f"e{i}") for i in (1, 2))
    )
    blocks = scratch.write(running(blocks, "c", "k", ["e1", "e2"], F.bit_xor, _xor), "blocks")
    via = lambda c: F.struct(F.xxhash64(c).alias("hash"), F.col(c).alias("c"))
    start = {f"p{i}": _xor(F.col(f"e{i}"), F.col(f"b{i}")) for i in (1, 2)}
    same = blocks.withColumns(start).groupBy("k", "e1", "e2").agg(
        F.min("c").alias("conv_id"), F.min(via("c")).alias("via"), F.count("*").alias("n"), F.any_value("p1").alias("p1"), F.any_value("p2").alias("p2")
    )
    same = scratch.write(same, "classes")
    above = same.select((F.col("k") + 1).alias("k"), F.col("e1").alias("p1"), F.col("e2").alias("p2"), F.col("n").alias("above"))
    first = same.filter("k = 0").withColumn("above", F.lit(root["n"]))
    later = same.filter("k > 0").join(above, ["k", "p1", "p2"]).select(first.columns)
    chosen = first.union(later).select(
        F.col("via.c").alias("c"), "k", "conv_id", "via", "n", (F.col("n") < F.col("above")).alias("parts"), "p1", "p2"
    )
    inner = Window.partitionBy("c", "k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    walked = cut.join(chosen, ["c", "k"])  # at most a block's turns for each row of chosen
    for i in (1, 2):
        walked = walked.withColumn(f"t{i}", _xor(F.col(f"p{i}"), F.bit_xor(f"x{i}").over(inner)))
        walked = walked.withColumn(f"q{i}", _xor(F.col(f"t{i}"), F.col(f"x{i}")))
    walked = walked.select(
        (F.col("pos") + 1).alias("depth"), "t1", "t2", "q1", "q2", "conv_id", "via", F.col("n").alias("n_convs"), "words", "parts"
    )
    walked = scratch.write(walked, "walked")
    passed = walked.filter("NOT parts").drop("parts")
    parted = walked.filter("parts").groupBy(*NODE).agg(
        F.any_value("q1").alias("q1"), F.any_value("q2").alias("q2"), F.min("conv_id").alias("conv_id"),
        F.min("via").alias("via"), F.sum("n_convs").alias("n_convs"), F.any_value("words").alias("words"),
    )
    last = blocks.groupBy("c").agg(F.max_by(F.struct("e1", "e2"), "k").alias("last"))
    ends = convs.join(last, "c", "left").select(
        F.col("turns").alias("depth"), *(F.coalesce(f"last.e{i}", F.lit(0)).alias(f"t{i}") for i in (1, 2)), "c"
    )
    return passed.union(parted.select(passed.columns)), ends


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of node and id: runs of a node's ids as comma-joined text."""
    for batch in batches:
        node = [batch.column(c).to_numpy() for c in NODE]
        ids = batch.column("c").to_numpy()
        new = np.zeros(len(ids), bool)
        new[::IDS] = True
        for column in node:
            new[1:] |= column[1:] != column[:-1]
        start = np.flatnonzero(new)
        text = ids.astype(str).tolist()
        joined = [",".join(text[a:b]) for a, b in zip(start, [*start[1:], len(ids)])]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c[start]) for c in node), pa.array(ids[start]), pa.array(joined, pa.string())], [*NODE, "first", "ids"]
        )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's texts, which come one after another; one digest is held at a time."""
    node, state = None, None
    for batch in batches:
        done = []
        for *key, text in zip(*(batch.column(c).to_pylist() for c in [*NODE, "ids"])):
            if key == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            state.update(text.encode())
        yield _digests(done)
    if node is not None:
        yield _digests([(*node, state.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*NODE, "ends_sha256"])


def _end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's ended members. Lists are written by ranges of ids, so only a
    hot node's finished pieces meet in one task, which must hash them in order."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*NODE, "c"]
    rows = ends.select(*(F.col(c).cast("bigint") for c in order)).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    pieces = rows.mapInArrow(_listed, "depth bigint, t1 bigint, t2 bigint, first bigint, ids string")
    dealt = pieces.repartition(parts, *NODE).sortWithinPartitions(*NODE, "first")
    return dealt.mapInArrow(_hashed, "depth bigint, t1 bigint, t2 bigint, ends_sha256 string")


def _subtree_sums(tree: DataFrame, sums: list[str], scratch: Scratch) -> DataFrame:
    """``tree`` with ``sums`` taken over each node's subtree."""
    hung = tree.filter("depth > 0 AND via <> parent_via").select("via", "parent_via", (F.col("depth") - 1).alias("depth"))
    total = lambda c: F.sum(c).alias(c)
    level, handed = tree.groupBy("via").agg(*map(total, sums)), []
    while True:  # as many rounds as the most changes of path between a leaf and the root
        up = level.join(hung, "via").groupBy(F.col("parent_via").alias("via"), "depth").agg(*map(total, sums))
        up = scratch.write(up, f"handed-{len(handed)}")
        if up.isEmpty():
            break
        handed.append(up)
        level = up.groupBy("via").agg(*map(total, sums))
    if handed:
        gained = reduce(DataFrame.union, handed).groupBy("via", "depth").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
        tree = tree.join(gained, ["via", "depth"], "left")
        tree = tree.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in sums}).drop(*(f"_{c}" for c in sums))
    deepest_first = tree.withColumn("_up", -F.col("depth"))
    return running(deepest_first, "via", "_up", sums, F.sum, lambda a, b: a + b).drop("_up")


def conversation_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations (``forks``).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``. Turns go by ``turn``, null first;
    equal ones by the SHA-256 of role and text, so repeated rows are turns of their own. Null
    role or text is empty. Rows without ``conv_id`` belong to no conversation. No
    conversation gives no node, not even the root. Other columns are not read.
    """
    scratch = Scratch("trie")
    convs, turns = forks(conversations, scratch)
    root = convs.agg(
        F.count("*").alias("n"), F.min("c").alias("conv_id"), F.min(F.struct(F.xxhash64("c").alias("hash"), "c")).alias("via")
    ).first()
    nodes, ends = _nodes(convs, turns, root, scratch, block)
    nodes = nodes.withColumn("via", F.col("via.c"))
    top = F.lit(root["via"] and root["via"]["c"]).cast("bigint")
    zero, first = F.lit(0).cast("bigint"), F.lit(root["conv_id"]).cast("bigint")
    trunk = conversations.sparkSession.range(1 if root["n"] else 0).select(
        zero.alias("depth"), zero.alias("t1"), zero.alias("t2"), F.lit(None).cast("bigint").alias("q1"), F.lit(None).cast("bigint").alias("q2"),
        first.alias("conv_id"), top.alias("via"), F.lit(root["n"]).cast("bigint").alias("n_convs"), zero.alias("words"),
    )
    nodes = scratch.write(nodes.union(trunk), "nodes")

    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("t1"), F.col("q2").alias("t2"))
    tree = nodes.join(children.agg(F.count("*").alias("n_children")), NODE, "left").join(_end_digests(ends), NODE, "left")
    own = {
        "n_children": F.coalesce("n_children", F.lit(0)),
        "ends_sha256": F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("words"),
    }
    tree = tree.withColumns(own).withColumn("n_leaves", (F.col("n_children") == 0).cast("bigint"))
    above = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("t1").alias("q1"), F.col("t2").alias("q2"),
        F.col("conv_id").alias("parent_conv_id"), F.col("via").alias("parent_via"),
    )
    shallow = tree.filter("depth < 2").withColumns(
        {"parent_conv_id": F.when(F.col("depth") > 0, first), "parent_via": F.when(F.col("depth") > 0, top)}
    )
    deep = tree.filter("depth > 1").join(above, PARENT)
    tree = scratch.write(shallow.unionByName(deep), "tree")
    return _subtree_sums(tree, ["n_leaves", "saved_tokens"], scratch).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
