"""Two building blocks that keep a hot key off a single task.

``carry_seeds`` turns a running window over a whole key into windows over short
time chunks of that key. ``salted_join`` attaches one row per key to a side in
which a single key may hold a large share of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK = "hour"
DEFAULT_SALTS = 16


def time_chunk(ts: Column, width: str = DEFAULT_CHUNK) -> Column:
    """Chunk key of a timestamp: any ``date_trunc`` unit."""
    return F.date_trunc(width, ts)


def carry_seeds(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    summary: dict[str, Column],
    carry: dict[str, Callable[[Column], Column]],
) -> DataFrame:
    """One row per (keys, chunk): the state carried in from all earlier chunks.

    ``summary`` reduces a chunk to a few columns. That is a plain aggregation,
    combined map-side, so a hot key costs no more than its number of chunks.
    ``carry`` then folds each summary over the earlier chunks of the same key.
    The caller unions these rows in front of the chunk's own rows and windows
    over ``keys + [chunk]``: the full table is shuffled once, in small groups.
    """
    per_chunk = df.groupBy(*keys, chunk).agg(*[c.alias(n) for n, c in summary.items()])
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(chunk)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return per_chunk.select(
        *keys, chunk, *[fold(F.col(n)).over(earlier).alias(n) for n, fold in carry.items()]
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    salt_by: Sequence[str],
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """Join that spreads each left key over ``salts`` partitions.

    ``right`` should hold few rows per key: it is repeated ``salts`` times, and both sides
    are shuffled and merged. The optimizer takes the repeated rows to be as many as before,
    so without the hint it gathers and broadcasts them from the driver, however many they are.
    ``salt_by`` names left columns that differ between rows of one key. The salt
    is a hash of them, so a recomputed task yields the same rows.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join cannot keep right rows single for how={how!r}")
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated.hint("merge"), [*on, "_salt"], how).drop("_salt")
