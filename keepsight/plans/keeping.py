"""Retention, verification rotation and quota over the events table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from keepsight.operators import retention as keep
from keepsight.operators import runs as ops
from keepsight.operators import verify
from keepsight.plans import tables as t
from keepsight.plans.registry import query

NOW = dt.datetime(2024, 1, 31)
REPORTS_NOW = dt.datetime(2001, 8, 2)
SHARDS = 8

_PLAN = """
  ranked AS (
    SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts DESC, snapshot_id DESC) AS rn,
      row_number() OVER (PARTITION BY host, date_trunc('day', ts) ORDER BY ts DESC, snapshot_id DESC) AS d1,
      row_number() OVER (PARTITION BY host, date_trunc('week', ts) ORDER BY ts DESC, snapshot_id DESC) AS w1,
      row_number() OVER (PARTITION BY host, date_trunc('month', ts) ORDER BY ts DESC, snapshot_id DESC) AS m1,
      row_number() OVER (PARTITION BY host, date_trunc('year', ts) ORDER BY ts DESC, snapshot_id DESC) AS y1,
      dense_rank() OVER (PARTITION BY host ORDER BY date_trunc('day', ts) DESC) AS d,
      dense_rank() OVER (PARTITION BY host ORDER BY date_trunc('week', ts) DESC) AS w,
      dense_rank() OVER (PARTITION BY host ORDER BY date_trunc('month', ts) DESC) AS m,
      dense_rank() OVER (PARTITION BY host ORDER BY date_trunc('year', ts) DESC) AS y
    FROM snapshots),
  plan AS (
    SELECT host, snapshot_id, ts, concat_ws(',',
      CASE WHEN d1 = 1 AND d <= 7 THEN 'daily' END, CASE WHEN rn <= 3 THEN 'last' END,
      CASE WHEN m1 = 1 AND m <= 12 THEN 'monthly' END, CASE WHEN w1 = 1 AND w <= 4 THEN 'weekly' END,
      CASE WHEN y1 = 1 AND y <= 3 THEN 'yearly' END) AS reasons
    FROM ranked)
"""


def _plan(spark, sf_dir):
    return keep.retention_plan(t.snapshots(spark, sf_dir), keep.RetentionPolicy(), ["host"])


@query(
    "retention_plan",
    f"WITH snapshots AS ({t.CTE['snapshots']}), {_PLAN} "
    "SELECT host, snapshot_id, ts, reasons <> '' AS keep, reasons FROM plan",
)
def retention_plan(spark, sf_dir):
    return _plan(spark, sf_dir).withColumn("reasons", F.array_join("reasons", ","))


@query(
    "prune_guard",
    f"WITH snapshots AS ({t.CTE['snapshots']}), {_PLAN} "
    """SELECT host, count(*) AS snapshots, count(*) FILTER (reasons = '') AS removed,
         round(count(*) FILTER (reasons = '') / count(*), 4) AS share,
         count(*) FILTER (reasons = '') <= count(*) * 0.25 AS allowed
       FROM plan GROUP BY host""",
)
def prune_guard(spark, sf_dir):
    return keep.prune_guard(_plan(spark, sf_dir), ["host"])


@query(
    "latest_per_group",
    "SELECT user_id AS host, max_by(event_id, (ts, event_id)) AS snapshot_id, max(ts) AS ts "
    "FROM events GROUP BY user_id",
)
def latest_per_group(spark, sf_dir):
    return keep.latest_per_group(t.snapshots(spark, sf_dir), ["host"], "ts", "snapshot_id")


@query(
    "check_retention_safe",
    """SELECT c_custkey AS doc_id, 'retention' AS path, 'retention_safe' AS rule,
         'policy would keep a single snapshot' AS message
       FROM customer
       WHERE c_nationkey % 3 < 2 AND c_nationkey % 2 = 0 AND c_nationkey % 5 = 0
         AND c_nationkey < 12 AND c_nationkey % 4 = 0""",
)
def check_retention_safe(spark, sf_dir):
    key = F.col("c_nationkey")
    policies = t.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("doc_id"),
        (key % 3).alias("keep_last"),
        (key % 2).alias("keep_daily"),
        (key % 5).alias("keep_weekly"),
        F.floor(key / 12).alias("keep_monthly"),
        (key % 4).alias("keep_yearly"),
    )
    return keep.check_retention_safe(policies)


@query(
    "report_retention",
    t.with_tables(
        "reports",
        body="""SELECT source, run_id, started_at, position FROM (
          SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, run_id DESC) AS position
          FROM reports) WHERE position <= 5 AND started_at >= TIMESTAMP '2001-08-02' - INTERVAL 400 DAY""",
    ),
)
def report_retention(spark, sf_dir):
    return keep.report_retention(
        t.reports(spark, sf_dir).select("source", "run_id", "started_at"),
        ["source"],
        "started_at",
        "run_id",
        F.lit(REPORTS_NOW).cast("timestamp_ntz"),
        keep=5,
    ).select("source", "run_id", "started_at", F.col("position").cast("bigint"))


@query(
    "attach_policy",
    t.with_tables(
        "runs",
        "bands",
        body="""SELECT run_id, source, files, min_files, min_bytes, max_shrink_pct
                FROM runs LEFT JOIN bands USING (source)""",
    ),
)
def attach_policy(spark, sf_dir):
    runs = t.runs(spark, sf_dir).select("run_id", "source", "files")
    return keep.attach_policy(runs, t.bands(spark, sf_dir), ["source"])


@query(
    "verify_shards",
    """SELECT doc_id, CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 52 + 1 AS INT) AS shard
       FROM documents""",
)
def verify_shards(spark, sf_dir):
    return verify.verify_shards(t.table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(
    "shard_volume",
    """SELECT CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 52 + 1 AS INT) AS shard,
         count(*) AS objects, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1""",
)
def shard_volume(spark, sf_dir):
    objects = t.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("bytes"))
    return verify.shard_volume(verify.verify_shards(objects, "doc_id"))


_PRIOR = """prior AS (
  SELECT *, CAST(coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (
    PARTITION BY repo ORDER BY ts, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n
  FROM verify_runs)"""


@query(
    "verify_cursor",
    f"WITH verify_runs AS ({t.CTE['verify_runs']}), {_PRIOR} "
    "SELECT repo, run_id, ts, ok, CAST(n % 8 + 1 AS INT) AS shard_due FROM prior",
)
def verify_cursor(spark, sf_dir):
    runs = t.verify_runs(spark, sf_dir).drop("shard")
    return verify.verify_cursor(runs, SHARDS, chunk="day")


@query(
    "verify_coverage",
    t.with_tables(
        "verify_runs",
        last="SELECT repo, shard, max(ts) FILTER (ok) AS last_ok FROM verify_runs GROUP BY ALL",
        aged="""SELECT *, CAST(floor(epoch_us(TIMESTAMP '2024-01-31') / 86400000000.0
                  - epoch_us(last_ok) / 86400000000.0) AS BIGINT) AS age FROM last""",
        body="""SELECT repo, count(last_ok) AS verified, 8 - count(last_ok) AS never,
                  count(*) FILTER (age > 10) AS stale,
                  CASE WHEN count(last_ok) = 8 THEN max(age) END AS days_since_full
                FROM aged GROUP BY repo""",
    ),
)
def verify_coverage(spark, sf_dir):
    return verify.verify_coverage(t.verify_runs(spark, sf_dir), SHARDS, F.lit(NOW), stale_days=10)


@query(
    "frozen_shard",
    f"WITH verify_runs AS ({t.CTE['verify_runs']}), {_PRIOR} "
    """SELECT repo, CAST(n % 8 + 1 AS INT) AS shard, count(*) AS streak, min(ts) AS since, max(ts) AS until
       FROM prior WHERE NOT ok GROUP BY repo, n HAVING count(*) >= 3""",
)
def frozen_shard(spark, sf_dir):
    return verify.frozen_shard(
        t.verify_runs(spark, sf_dir).drop("shard"), SHARDS, 3, chunk="day"
    )


@query(
    "quota_trend",
    t.with_tables(
        "quota",
        lagged="""SELECT *, used - lag(used) OVER (PARTITION BY repo ORDER BY taken_at, used) AS delta
                  FROM quota""",
        slopes="""SELECT repo, regr_slope(used, epoch_us(taken_at) / 86400000000.0 - 18262) AS slope
                  FROM quota WHERE used IS NOT NULL GROUP BY repo""",
        body="""SELECT repo, taken_at, used, total, delta,
                  CASE WHEN used IS NULL THEN NULL WHEN total * 0.7 <= used THEN 0.0
                    WHEN slope > 0 THEN round((total * 0.7 - used) / slope, 1) END AS runway_days
                FROM lagged LEFT JOIN slopes USING (repo)""",
    ),
)
def quota_trend(spark, sf_dir):
    return ops.quota_trend(t.quota(spark, sf_dir), chunk="day")


@query(
    "quota_reclaim",
    """SELECT user_id AS prune_id,
         max(CASE WHEN event_type = 'view' THEN CAST(round(value * 1000000) AS BIGINT) END) AS used_before,
         max(CASE WHEN event_type = 'click' THEN CAST(round(value * 1000000) AS BIGINT) END) AS used_after,
         used_before - used_after AS freed,
         CASE WHEN freed IS NULL THEN 'unknown' WHEN freed > 0 THEN 'reclaimed' ELSE 'not_reclaimed' END AS outcome
       FROM events GROUP BY user_id""",
)
def quota_reclaim(spark, sf_dir):
    readings = t.events(spark, sf_dir).select(
        F.col("user_id").alias("prune_id"),
        t.case_of(F.col("event_type"), {"view": "before", "click": "after"}).alias("label"),
        t.bytes_of().alias("used"),
    )
    return ops.quota_reclaim(readings)
