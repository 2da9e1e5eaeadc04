"""Which snapshots and reports a policy keeps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsight.operators.skew import salted_join


@dataclass(frozen=True)
class RetentionPolicy:
    # Default policy.
    keep_last: int = 3
    keep_daily: int = 7
    keep_weekly: int = 4
    keep_monthly: int = 12
    keep_yearly: int = 3
    timezone: str = "UTC"

    def periods(self) -> list[tuple[str, str, int]]:
        """``(reason, date_trunc unit, n)`` of each period rule in force."""
        rules = [
            ("daily", "day", self.keep_daily),
            ("weekly", "week", self.keep_weekly),
            ("monthly", "month", self.keep_monthly),
            ("yearly", "year", self.keep_yearly),
        ]
        return [rule for rule in rules if rule[2] > 0]

    def check(self) -> None:
        """Refuse a policy that would keep a single snapshot or less."""
        counts = (self.keep_daily, self.keep_weekly, self.keep_monthly, self.keep_yearly)
        if min(self.keep_last, *counts) < 0:
            raise ValueError("retention counts must not be negative")
        if self.keep_last < 2 and not any(counts):
            raise ValueError("retention policy would keep a single snapshot")


# Prune guard share and report retention.
MAX_PRUNE_SHARE = 0.25
REPORTS_KEEP = 200
REPORTS_KEEP_DAYS = 400


def _local_day(rows: DataFrame, ts: str, timezone: str) -> Column:
    """The policy zone's date of an instant, whatever the session's zone.

    A time without a zone means UTC.
    """
    utc = F.col(ts)
    if not isinstance(rows.schema[ts].dataType, T.TimestampNTZType):
        seconds = F.unix_seconds(utc.cast("timestamp")).cast("decimal(18,6)")
        utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    return F.convert_timezone(F.lit("UTC"), F.lit(timezone), utc).cast("date")


def retention_keepers(
    snapshots: DataFrame, policy: RetentionPolicy, group_cols: Sequence[str], ts: str, id_col: str
) -> DataFrame:
    """Only the snapshots a policy keeps, with sorted ``reasons``.

    Two small reductions of the table, both combined before the shuffle: the
    newest ``keep_last`` rows per group, and the newest row per group and day.
    The newest snapshot of a week, month or year is the newest of its newest
    day, so every period rule works on the day table.
    """
    policy.check()
    groups = list(group_cols)
    base = snapshots.select(*groups, F.col(ts).alias("_ts"), F.col(id_col).alias("_id"))
    newest = Window.partitionBy(*groups).orderBy(F.desc("_ts"), F.desc("_id"))
    parts = []
    if policy.keep_last > 0:
        parts.append(
            base.withColumn("_rn", F.row_number().over(newest))
            .filter(F.col("_rn") <= policy.keep_last)
            .select(*groups, "_ts", "_id", F.array(F.lit("last")).alias("_why"))
        )
    periods = policy.periods()
    if periods:
        # the local day is kept as a date, so it truncates the same everywhere
        day = _local_day(base, "_ts", policy.timezone)
        days = (
            base.groupBy(*groups, day.alias("_day"))
            .agg(F.max(F.struct("_ts", "_id")).alias("_top"))
            .withColumns({f"_{unit}": F.trunc("_day", unit) for _, unit, _ in periods if unit != "day"})
        )
        per_group = Window.partitionBy(*groups)
        whys = []
        for name, unit, keep in periods:
            bucket = f"_{unit}"
            first = F.row_number().over(
                Window.partitionBy(*groups, bucket).orderBy(F.desc("_day"))
            )
            rank = F.dense_rank().over(per_group.orderBy(F.desc(bucket)))
            days = days.withColumns({f"_n_{name}": first, f"_r_{name}": rank})
            hit = (F.col(f"_n_{name}") == 1) & (F.col(f"_r_{name}") <= keep)
            whys.append(F.when(hit, F.lit(name)))
        parts.append(
            days.select(
                *groups,
                F.col("_top._ts").alias("_ts"),
                F.col("_top._id").alias("_id"),
                F.array_compact(F.array(*whys)).alias("_why"),
            ).filter(F.size("_why") > 0)
        )
    kept = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return (
        kept.groupBy(*groups, "_ts", "_id")
        .agg(F.array_sort(F.flatten(F.collect_list("_why"))).alias("reasons"))
        .withColumnsRenamed({"_ts": ts, "_id": id_col})
    )


def retention_plan(
    snapshots: DataFrame,
    policy: RetentionPolicy,
    group_cols: Sequence[str] = ("host", "paths"),
    ts: str = "ts",
    id_col: str = "snapshot_id",
) -> DataFrame:
    """Every snapshot with ``keep`` and sorted ``reasons``.

    Marking is a join on group, time and id, so an id may repeat over groups: no
    group, however large, meets in one task, and the keepers (a few rows per
    group) are broadcast when they are measured to be small.
    """
    keys = [*group_cols, ts, id_col]
    keepers = retention_keepers(snapshots, policy, group_cols, ts, id_col)
    keepers = keepers.select(*[F.col(k).alias(f"_keeper_{n}") for n, k in enumerate(keys)], "reasons")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_keeper_{n}")) for n, k in enumerate(keys)])
    marked = snapshots.join(keepers, same, "left")
    return marked.select(
        *snapshots.columns,
        F.col("reasons").isNotNull().alias("keep"),
        F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"),
    )


def prune_guard(
    plan: DataFrame, group_cols: Sequence[str], max_share: float = MAX_PRUNE_SHARE
) -> DataFrame:
    """Per group: share of snapshots a plan removes, and whether that is allowed."""
    removed = F.count_if(~F.col("keep"))
    total = F.count(F.lit(1))
    return plan.groupBy(*group_cols).agg(
        total.alias("snapshots"),
        removed.alias("removed"),
        F.round(removed / total, 4).alias("share"),
        (removed <= total * F.lit(max_share)).alias("allowed"),
    )


def check_retention_safe(policies: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Policies that would keep a single snapshot: all periods off and ``keep_last`` < 2."""
    periods = ["keep_daily", "keep_weekly", "keep_monthly", "keep_yearly"]
    unsafe = F.col("keep_last") < 2
    for name in periods:
        unsafe = unsafe & (F.col(name) == 0)
    return policies.filter(unsafe).select(
        F.col(id_col),
        F.lit("retention").alias("path"),
        F.lit("retention_safe").alias("rule"),
        F.lit("policy would keep a single snapshot").alias("message"),
    )


def report_retention(
    reports: DataFrame,
    group_cols: Sequence[str],
    ts: str,
    id_col: str,
    now: Column,
    keep: int = REPORTS_KEEP,
    keep_days: int = REPORTS_KEEP_DAYS,
) -> DataFrame:
    """Reports to keep: among the newest ``keep`` of their group and young enough.

    The age filter reaches the scan. Only the newest ``keep`` rows per group and
    map task are shuffled.
    """
    order = Window.partitionBy(*group_cols).orderBy(F.desc(ts), F.desc(id_col))
    return (
        reports.filter(F.col(ts) >= now - F.make_dt_interval(days=F.lit(keep_days)))
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= keep)
    )


def latest_per_group(
    snapshots: DataFrame, group_cols: Sequence[str], ts: str, id_col: str
) -> DataFrame:
    """Newest snapshot of each group, ties to the larger id; whole rows."""
    value = F.struct(*[c for c in snapshots.columns if c not in group_cols])
    return (
        snapshots.groupBy(*group_cols)
        .agg(F.max_by(value, F.struct(ts, id_col)).alias("_row"))
        .select(*group_cols, "_row.*")
    )


def attach_policy(
    runs: DataFrame, policies: DataFrame, on: Sequence[str], run_id: str = "run_id"
) -> DataFrame:
    """Each run with the policy of its source; runs without one keep nulls."""
    return salted_join(runs, policies, on, "left", [run_id])
