"""Rotating verification: shards, the cursor over them, coverage and stuck rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsight.functions.shards import shard_of
from keepsight.operators.skew import DEFAULT_CHUNK, carry_seeds, time_chunk

# Fixed value: default number of shards.
DEFAULT_SHARDS = 52


def verify_shards(
    objects: DataFrame, key: str, shards: int = DEFAULT_SHARDS, method: str = "sha256"
) -> DataFrame:
    """Each object with its shard 1..``shards``; no shuffle."""
    return objects.withColumn("shard", shard_of(F.col(key), shards, method))


def shard_volume(sharded: DataFrame, size: str = "bytes") -> DataFrame:
    """Objects and bytes per shard."""
    return sharded.groupBy("shard").agg(
        F.count(F.lit(1)).alias("objects"), F.sum(size).cast("bigint").alias("bytes")
    )


def _with_prior_successes(
    verify_runs: DataFrame, repo: str, chunk: str
) -> DataFrame:
    rows = verify_runs.withColumns(
        {
            "_chunk": time_chunk(F.col("ts"), chunk),
            "_ok": F.when(F.col("ok"), F.lit(1)).otherwise(F.lit(0)).cast("bigint"),
        }
    )
    seeds = carry_seeds(rows, [repo], "_chunk", {"_ok": F.sum("_ok")}, {"_ok": F.sum})
    both = rows.withColumn("_seed", F.lit(1)).unionByName(
        seeds.withColumn("_seed", F.lit(0)), allowMissingColumns=True
    )
    before = (
        Window.partitionBy(repo, "_chunk")
        .orderBy("_seed", "ts", "run_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        both.withColumn("_prior", F.coalesce(F.sum("_ok").over(before), F.lit(0)))
        .filter("_seed = 1")
        .select(*verify_runs.columns, "_prior")
    )


def _shard_due(prior: Column, shards: int) -> Column:
    return (prior % shards + 1).cast("int")


def verify_cursor(
    verify_runs: DataFrame,
    shards: int = DEFAULT_SHARDS,
    repo: str = "repo",
    chunk: str = DEFAULT_CHUNK,
) -> DataFrame:
    """Shard due at each run. The cursor moves past a shard only when its run succeeds.

    ``verify_runs``: repo, ``run_id``, ``ts``, ``ok``.
    """
    return _with_prior_successes(verify_runs, repo, chunk).select(
        *verify_runs.columns, _shard_due(F.col("_prior"), shards).alias("shard_due")
    )


def verify_coverage(
    verify_runs: DataFrame,
    shards: int,
    now: Column,
    stale_days: int | None = None,
    repo: str = "repo",
) -> DataFrame:
    """Per repository: days since every shard had been verified, stale and never-verified shards.

    ``verify_runs``: repo, ``shard``, ``ts``, ``ok``. ``days_since_full`` is null
    until every shard has passed once. Shards count as stale past ``stale_days``
    (default: one day per shard and week).
    """
    limit = shards * 7 if stale_days is None else stale_days
    last = verify_runs.groupBy(repo, "shard").agg(
        F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_ok")
    )
    in_range = F.col("last_ok").isNotNull() & F.col("shard").between(1, shards)
    age = F.floor(
        (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_ok").cast("timestamp")))
        / (86_400 * 1_000_000)
    ).cast("bigint")
    passed = F.count_if(in_range)
    return last.groupBy(repo).agg(
        passed.alias("verified"),
        (F.lit(shards) - passed).alias("never"),
        F.count_if(in_range & (age > limit)).alias("stale"),
        F.when(passed == shards, F.max(F.when(in_range, age))).alias("days_since_full"),
    )


def frozen_shard(
    verify_runs: DataFrame,
    shards: int = DEFAULT_SHARDS,
    k: int = 3,
    repo: str = "repo",
    chunk: str = DEFAULT_CHUNK,
) -> DataFrame:
    """Shards that failed at least ``k`` times in a row, so the rotation stood still.

    Between two successes the cursor does not move, so a streak is the failures
    that share a count of earlier successes: one aggregation, no second window.
    """
    return (
        _with_prior_successes(verify_runs, repo, chunk)
        .filter(~F.col("ok"))
        .groupBy(repo, "_prior")
        .agg(
            F.count(F.lit(1)).alias("streak"),
            F.min("ts").alias("since"),
            F.max("ts").alias("until"),
        )
        .filter(F.col("streak") >= k)
        .select(repo, _shard_due(F.col("_prior"), shards).alias("shard"), "streak", "since", "until")
    )
