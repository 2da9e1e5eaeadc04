"""Positions in a global order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsight.llm.storage import Scratch


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = len(batch)
        numbers = pa.array(range(seen, seen + n), pa.int64())
        parts = pc.if_else(pc.is_null(numbers), None, pa.scalar(part, pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, parts, numbers], [*batch.schema.names, "_part", "_number"]
        )
        seen += n


def ranked(df: DataFrame, order: list[str], scratch: Scratch, name: str = "ranked") -> DataFrame:
    """``df`` with ``rank``: its row's place from 0 when all rows are sorted by ``order``.

    The rows are dealt by ranges of the order, numbered where they lie, and written;
    then each range's numbers go up by the rows of the ranges before it, one small row
    for each range. Rows equal in every order column take places in any order, so
    ``order`` should tell rows apart or leave only equal rows tied.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    added = [T.StructField("_part", T.IntegerType()), T.StructField("_number", T.LongType())]
    schema = T.StructType([*df.schema.fields, *added])
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = scratch.write(dealt.mapInArrow(_numbered, schema), name)
    counts = sorted((r["_part"], r["n"]) for r in kept.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    offsets = spark.createDataFrame(before, "_part int, _before bigint")
    return (
        kept.join(F.broadcast(offsets), "_part")
        .withColumn("rank", F.col("_number") + F.col("_before"))
        .drop("_part", "_number", "_before")
    )


def placed(
    df: DataFrame, order: list[str], scratch: Scratch, sums: tuple[str, ...] = (), name: str = "placed"
) -> DataFrame:
    """``ranked``, and for each whole-number column of ``sums`` its total ``<column>_before`` the row.

    Nulls count as 0. Every column of ``df`` stays.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    locals_ = [f"_local_{c}" for c in sums]
    added = ["_part int", "_number bigint", *(f"{c} bigint" for c in locals_)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, totals = TaskContext.get().partitionId(), 0, [0] * len(sums)
        for batch in batches:
            n, columns = len(batch), list(batch.columns)
            columns.append(pa.array(np.full(n, part, np.int32)))
            columns.append(pa.array(np.arange(seen, seen + n, dtype=np.int64)))
            for k, c in enumerate(sums):
                value = batch.column(c).fill_null(0).cast(pa.int64()).to_numpy()
                upto = np.cumsum(value) + totals[k]
                columns.append(pa.array(upto - value))
                totals[k] = int(upto[-1]) if n else totals[k]
            seen += n
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_part", "_number", *locals_])

    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(", ".join(added)).fields])
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = scratch.write(dealt.mapInArrow(walk, schema), name)
    each = kept.groupBy("_part").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in sums)).collect()
    before, totals = [], [0] * (1 + len(sums))
    for row in sorted(each, key=lambda r: r["_part"]):
        before.append((row["_part"], *totals))
        totals = [t + (row[c] or 0) for t, c in zip(totals, ["n", *sums])]
    names = ["_before", *(f"_before_{c}" for c in sums)]
    offsets = spark.createDataFrame(before, ", ".join(["_part int", *(f"{c} bigint" for c in names)]))
    out = kept.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_number") + F.col("_before"))
    for c, local in zip(sums, locals_):
        out = out.withColumn(f"{c}_before", F.col(local) + F.col(f"_before_{c}"))
    return out.drop("_part", "_number", *locals_, *names)
