"""Mixing sources to target weights by a low-discrepancy schedule.

A source's documents stand in a shuffled order, one after another, and over again where
its target is above its size; this stream is cut into blocks of equally many words. The
mix has one slot for each block. Slot i has the golden-ratio point frac(i * phi); in the
order of their points the slots are handed out along the sources' cumulative numbers of
blocks, so every stretch of the mix holds each source in nearly its share. A source's r-th
slot takes its r-th block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsight.llm.order import placed, ranked
from keepsight.llm.storage import Scratch
from keepsight.llm.words import NOT_BLANK, cuts, utf8, word_spans

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)  # 2^64 / phi, odd: every point is another


@dataclass(frozen=True)
class Mix:
    """The sources' ``weights`` by code point, repeating; the ``share`` of all words that the mix
    takes, the ``most`` times a source is taken, the words of a ``block``."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    block: int = 256


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``doc_id, source, size`` of every row: words between ASCII white space, null text none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            size = np.zeros(len(batch), np.int64)
            for at, part, ends in cuts(data, offsets):
                n = np.diff(word_spans(part, ends, NOT_BLANK)[2])
                size[at : at + len(n)] += n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size)], ["doc_id", "source", "size"])

    rows = docs.select(F.col(id_col).cast("bigint"), F.col(source_col).cast("string"), F.col(text_col).cast("string"))
    return rows.mapInArrow(count, "doc_id bigint, source string, size bigint")


def targets(sizes: DataFrame, how: Mix, scratch: Scratch) -> DataFrame:
    """``source, at, source_size, weight, target`` of every source; ``at`` is its place by code point, null last.

    Each source gets the share of its weight, and no more than ``most`` times its size; what
    is over goes to the others by weight until none is above. A round is one sum over the
    sources, and the level it gives never falls.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("none", F.col("source").isNull())
    order = ranked(each, ["none", "source"], scratch, "sources").withColumnRenamed("rank", "at").drop("none")
    weight = F.element_at(F.array(*map(F.lit, how.weights)), (F.col("at") % len(how.weights) + 1).cast("int"))
    sources = scratch.write(order.withColumn("weight", weight.cast("bigint")), "weights")
    budget = how.share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    cap = how.most * F.col("source_size")
    level, full = 0.0, -1
    while True:
        over = cap < F.lit(level) * F.col("weight") if full >= 0 else F.lit(False)
        n, held, open_ = sources.agg(
            F.count_if(over), F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))
        ).first()
        if n == full or not open_:
            break
        full, level = n, (budget - held) / open_
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        point = batch.column(0).to_numpy().astype(np.uint64) * _GOLDEN  # modulo 2^64
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((point >> np.uint64(1)).astype(np.int64))], ["slot", "point"])


def schedule(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """``slot, at, block``: which block of which source each slot of the mix takes.

    ``sources`` has ``at``, ``blocks`` and ``blocks_before``, the sum over the sources before.
    """
    spark = sources.sparkSession
    slots = sources.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    points = spark.range(slots).mapInArrow(_points, "slot bigint, point bigint")
    points = ranked(points, ["point"], scratch, "points").select("slot", F.col("rank").alias("cell"))
    many = 1 << 16  # a hot source's cells are made in several tasks
    runs = sources.select("at", "blocks", "blocks_before", F.explode(F.sequence(F.lit(0), F.expr(f"(blocks - 1) div {many}"))).alias("run"))
    runs = runs.filter("blocks > 0").repartition(F.col("at"), F.col("run"))
    first, last = F.col("run") * many, F.least(F.col("blocks"), (F.col("run") + 1) * many) - 1
    before = F.col("blocks_before")
    cells = runs.select("at", "blocks_before", F.explode(F.sequence(before + first, before + last)).alias("cell"))
    # as many cells as blocks, though they come from few rows: not to be broadcast
    dealt = points.hint("merge").join(cells.hint("merge"), "cell").select("slot", "at", "blocks_before")
    return ranked(dealt, ["at", "slot"], scratch, "slots").select(
        "slot", "at", (F.col("rank") - F.col("blocks_before")).alias("block")
    )


def mixed(
    docs: DataFrame, how: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> tuple[DataFrame, DataFrame]:
    """The rows with their place, and the pieces of the mix.

    Rows: ``row, doc_id, source, size, source_size, target``, one for each row of ``docs``; a
    row without text has size 0. Pieces: ``slot, offset, row, start, length``: words ``start``
    to ``start + length`` of the row stand at ``offset`` in the slot. A source's pieces come
    to its target, rounded; a row's to no more than ``most`` times its size. Documents are
    shuffled by the MD5 of their id; a null id counts as empty text; equal ids go by size,
    and rows alike in all of these are one as good as the other, so reruns agree. A null
    source is a source; one without words has target 0. Other columns are not read.
    """
    scratch = Scratch("mix")
    sizes = sized(docs, id_col, text_col, source_col).withColumn("_row", F.monotonically_increasing_id())
    sizes = scratch.write(sizes, "sizes")  # from here on, rows alike are told apart by where they were written
    sources = targets(sizes, how, scratch)
    sources = sources.withColumn("wanted", F.round("target").cast("bigint"))
    sources = sources.withColumn("blocks", F.ceil(F.col("wanted") / how.block))
    sources = placed(sources, ["at"], scratch, ("source_size", "blocks"), "source-places").drop("rank")
    sources = scratch.write(sources, "sources")

    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    dealt = sizes.withColumns({"none": F.col("source").isNull(), "digest": digest})
    dealt = placed(dealt, ["none", "source", "digest", "doc_id", "size", "_row"], scratch, ("size",), "shuffled")
    known = dealt["source"].eqNullSafe(sources["source"])
    rows = dealt.join(sources, known).select(
        F.col("rank").alias("row"), "doc_id", dealt["source"], "size", "source_size", "target",
        "at", "wanted", (F.col("size_before") - F.col("source_size_before")).alias("start"),
    )
    rows = scratch.write(rows, "rows")

    width = how.block
    turns = F.explode(F.sequence(F.lit(0), F.lit(how.most - 1))).alias("turn")
    spans = rows.filter("size > 0").select("row", "at", "start", "size", "source_size", "wanted", turns)
    spans = spans.withColumn("low", F.col("start") + F.col("turn") * F.col("source_size"))
    spans = spans.withColumn("high", F.least(F.col("low") + F.col("size"), "wanted")).filter("high > low")
    cut = spans.withColumn("block", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))))
    cut = cut.withColumns({"_a": F.greatest("low", F.col("block") * width), "_b": F.least("high", (F.col("block") + 1) * width)})
    pieces = cut.select(
        "at", "block", (F.col("_a") - F.col("block") * width).alias("offset"),
        "row", (F.col("_a") - F.col("low")).alias("start"), (F.col("_b") - F.col("_a")).alias("length"),
    )
    pieces = pieces.hint("merge").join(schedule(sources, scratch).hint("merge"), ["at", "block"]).select("slot", "offset", "row", "start", "length")
    return rows.select("row", "doc_id", "source", "size", "source_size", "target"), pieces
