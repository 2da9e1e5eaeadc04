"""Sharding along a Hilbert curve through several metadata dimensions.

Each dimension is cut into 2^bits bins of about equal row counts, a row's bins are one
point of the curve, and rows sorted by their place on the curve are cut into runs. A
run is compact in every dimension, so the least and greatest values of a file tell
readers of any one dimension which files they can skip.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsight.llm.order import placed, ranked
from keepsight.llm.storage import Scratch


@dataclass(frozen=True)
class Curve:
    """``bits`` for each dimension; bounds are found to ``accuracy`` of a row share."""

    bits: int = 8
    accuracy: int = 10_000


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """The place on the curve of each row of ``points`` (rows by dimensions, below 2^bits).

    Works down from the highest bit: at each level the cell within the current cube is
    found in Gray-code order, and the cube is turned by exchanging or mirroring the
    remaining lower bits of two axes.
    """
    axes = [points[:, k].astype(np.uint64) for k in range(points.shape[1])]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for k, axis in enumerate(axes):
            upper = (axis & bit) != 0
            swapped = np.where(upper, np.uint64(0), (axes[0] ^ axis) & low)
            mirrored = np.where(upper, low, np.uint64(0))
            axes[0] = axes[0] ^ mirrored ^ swapped
            if k:
                axes[k] = axis ^ swapped
    for k in range(1, len(axes)):
        axes[k] = axes[k] ^ axes[k - 1]
    flips = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        flips ^= np.where(axes[-1] & np.uint64(1 << level), np.uint64((1 << level) - 1), np.uint64(0))
    axes = [axis ^ flips for axis in axes]
    index = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            index = (index << one) | ((axis >> np.uint64(level)) & one)
    return index


def _is_text(df: DataFrame, name: str) -> bool:
    kind = df.schema[name].dataType
    plain = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
    return not isinstance(kind, plain)


def _as_number(df: DataFrame, name: str) -> Column:
    """A number in the order of a column that is not text."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    if isinstance(kind, T.BooleanType):
        return F.col(name).cast("int").cast("double")
    return F.unix_micros(F.col(name).cast("timestamp")).cast("double")


def _as_bytes(name: str) -> Column:
    """A text column by its bytes, in whose order it is cut."""
    return F.col(name).cast("string").cast("binary")


def bin_bounds(df: DataFrame, dims: list[str], scratch: Scratch, curve: Curve = Curve()) -> dict[str, list]:
    """For each dimension, the values that cut all rows into about equal parts.

    Numbers and times: one aggregation with a partial sketch in every task. Text: its
    distinct values with their counts, in order of the whole values, cut where the rows
    before them pass a share; a value that fills several parts is one bound. At most
    2^bits - 1 values a dimension reach the driver whatever the number of rows.
    """
    parts = 1 << curve.bits
    shares = [k / parts for k in range(1, parts)]
    plain = [d for d in dims if not _is_text(df, d)]
    row = df.agg(
        F.count("*").alias("_rows"),
        *[F.percentile_approx(_as_number(df, d), shares, curve.accuracy).alias(f"_{k}") for k, d in enumerate(plain)],
    ).first()
    out = {d: sorted(set(row[f"_{k}"] or [])) for k, d in enumerate(plain)}
    for k, d in enumerate(dims):
        if d in out:
            continue
        values = df.select(_as_bytes(d).alias("value")).dropna().groupBy("value").agg(F.count("*").alias("weight"))
        values = placed(values, ["value"], scratch, ("weight",), f"values-{k}")
        total = values.agg(F.sum("weight")).first()[0] or 0
        # the part that a value's first row lies in; a part's first value is its bound
        part = F.expr(f"weight_before * {parts} DIV {max(total, 1)}").alias("part")
        firsts = values.select(part, "value").groupBy("part").agg(F.min("value").alias("value"))
        out[d] = sorted(bytes(r["value"]) for r in firsts.filter("part > 0").collect())
    return {d: out[d] for d in dims}


def _text_bins(column: pa.Array, bounds: list[bytes]) -> np.ndarray:
    """For each value, how many bounds it reaches; a null reaches none."""
    distinct = column.dictionary_encode()
    bins = np.array([bisect_right(bounds, v) for v in distinct.dictionary.to_pylist()], np.int64)
    if not len(bins):
        return np.zeros(len(column), np.int64)
    known = distinct.indices.is_valid().to_numpy(zero_copy_only=False)
    return np.where(known, bins[distinct.indices.fill_null(0).to_numpy()], 0)


def with_curve(
    df: DataFrame, dims: list[str], curve: Curve = Curve(), out: str = "curve", scratch: Scratch | None = None
) -> DataFrame:
    """``df`` with its rows' places on the curve; a null counts as the least value."""
    if len(dims) * curve.bits > 63:
        raise ValueError("dims times bits must stay below 64")
    bounds = list(bin_bounds(df, dims, scratch or Scratch("hilbert"), curve).values())
    texts, bits, names = [_is_text(df, d) for d in dims], curve.bits, [f"_dim{k}" for k in range(len(dims))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.zeros((len(batch), len(names)), np.int64)
            for k, name in enumerate(names):
                if texts[k]:
                    points[:, k] = _text_bins(batch.column(name), bounds[k])
                else:
                    value = batch.column(name).fill_null(float("-inf")).to_numpy(zero_copy_only=False)
                    points[:, k] = np.searchsorted(np.array(bounds[k]), value, "right")
            index = hilbert_index(points, bits).astype(np.int64)
            kept = [c for c in batch.schema.names if c not in names]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(index)], [*kept, out]
            )

    numbered = df.withColumns(
        {n: _as_bytes(d) if text else _as_number(df, d) for n, d, text in zip(names, dims, texts)}
    )
    return numbered.mapInArrow(place, T.StructType([*df.schema.fields, T.StructField(out, T.LongType())]))


def shard_rows(
    docs: DataFrame,
    shards: int,
    dims: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    curve: Curve = Curve(),
) -> DataFrame:
    """Every row's shard and slot, the counts of any two shards at most one apart.

    Returns ``id_col, size, text_crc32, curve, rank, shard, slot`` and the dimensions.
    The texts themselves are only measured, never shuffled. The law is ``rows``: a
    shard's rows are one run of the curve order, of n / shards rows up or down. Rows at
    one place on the curve go by id, then checksum, so a source, a language or a group
    of copies of any size is spread over as many shards as it fills. A null text has
    size 1 and the checksum of no bytes; a null id or dimension sorts first; equal rows
    have their own slots; an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch("hilbert")
    body = F.coalesce(F.col(text_col), F.lit(""))
    extra = [d for d in dims if d != id_col]
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(body).cast("bigint") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        *extra,
    )
    measured = scratch.write(rows, "measured")
    curved = with_curve(measured, dims, curve, scratch=scratch)
    order = ["curve", id_col, "text_crc32", *extra]
    in_order = ranked(curved, order, scratch)
    n = measured.count()
    # shard s holds the ranks from ceil(s * n / shards)
    shard = F.expr(f"CAST((rank * {shards}) DIV {max(n, 1)} AS INT)")
    first = F.expr(f"(CAST(shard AS BIGINT) * {n} + {shards - 1}) DIV {shards}")
    return in_order.withColumn("shard", shard).withColumn("slot", F.col("rank") - first)


def file_ranges(sharded: DataFrame, dims: list[str], run_rows: int = 1_000_000) -> DataFrame:
    """Least and greatest value of every dimension in each run of a shard: what a reader prunes by."""
    run = F.floor(F.col("slot") / run_rows).alias("run")
    stats = [f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard", run).agg(F.count("*").alias("n_rows"), F.sum("size").alias("bytes"), *stats)
