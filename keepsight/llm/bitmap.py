"""A bitmap of hashed keys: a filter of fixed size that never loses a key."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BUCKET = 32_768  # bits that bitmap_construct_agg covers


def place(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(bits))


def build(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """The bits set for the 64-bit ``key`` column; ``bits`` / 8 bytes whatever the rows are.

    Built by a partial aggregation in every task; more keys than bits only make the filter
    let more through.
    """
    p = keys.select(place(F.col(key), bits).alias("p"))
    grouped = p.groupBy(F.expr(f"p DIV {_BUCKET}").alias("bucket"))
    out = np.zeros(bits // 8, np.uint8)
    for row in grouped.agg(F.bitmap_construct_agg(F.expr(f"p % {_BUCKET}")).alias("bits")).collect():
        at = row["bucket"] * (_BUCKET // 8)
        out[at : at + _BUCKET // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def holds(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether each place (below the number of bits) is set."""
    return (bitmap[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
