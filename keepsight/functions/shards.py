"""Portable shard assignment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shard_of(key: Column, shards: int, method: str = "sha256") -> Column:
    """Shard 1..``shards`` of a key.

    ``sha256`` uses the first 32 bits of the digest, which any engine can
    reproduce; ``xxhash64`` is cheaper and Spark-only.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = key.cast("string")
    if method == "sha256":
        bucket = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    elif method == "xxhash64":
        bucket = F.xxhash64(text)
    else:
        raise ValueError(f"unknown shard method: {method}")
    return (F.pmod(bucket, F.lit(shards)) + 1).cast("int")
