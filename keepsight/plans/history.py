"""Run history: log values, rates, verdicts, baselines, schedules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from keepsight.operators import events as ev
from keepsight.operators import runs as ops
from keepsight.operators import schedule
from keepsight.operators.inventory import inventory_totals, ledger_union
from keepsight.plans import tables as t
from keepsight.plans.registry import query
from keepsight.sources.readers import parse_event_lines

NOW = dt.datetime(2024, 1, 31)
HORIZON = (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31))
CRONS = ["0 2 * * *", "30 */6 * * 1-5", "0 5 * * 0", "15,45 3-4 1,15 * *"]


def _log(spark, sf_dir):
    lines = t.stored(t.log_lines(spark, sf_dir), "log_lines")
    return parse_event_lines(lines).filter(F.col("event").isNotNull())


@query(
    "event_select",
    t.with_tables(
        "log_lines",
        body="""SELECT run_id, line_no,
                  CASE WHEN is_false THEN 'false' WHEN NOT is_null THEN CAST(bytes_done AS VARCHAR) END AS value
                FROM log_lines WHERE readable AND message_type = 'status'""",
    ),
)
def event_select(spark, sf_dir):
    return ev.event_select(_log(spark, sf_dir), "status", "bytes_done")


@query(
    "last_event_value",
    t.with_tables(
        "log_lines",
        body="""SELECT run_id, max_by(CAST(bytes_done AS VARCHAR), line_no) AS value
                FROM log_lines WHERE readable AND message_type = 'status' AND bytes_done IS NOT NULL
                GROUP BY run_id""",
    ),
)
def last_event_value(spark, sf_dir):
    return ev.last_event_value(_log(spark, sf_dir), "status", "bytes_done")


_RATES = """SELECT source AS run_id, CAST(sum(bytes) AS BIGINT) AS bytes,
  CAST(floor((epoch_us(max(finished_at)) - epoch_us(min(started_at))) / 1000000) AS BIGINT) AS seconds,
  CASE WHEN seconds > 0 THEN CAST(printf('%.2f', CAST(sum(bytes) AS DOUBLE) / seconds / 1000000) AS DOUBLE) END AS mb_s
  FROM day_runs GROUP BY source"""
_DAY_RUNS = """SELECT run_id AS source, started_at, finished_at, bytes * 10 AS bytes FROM runs"""


def _rates(spark, sf_dir):
    return ops.throughput(t.runs(spark, sf_dir).withColumn("bytes", F.col("bytes") * 10))


@query("throughput", t.with_tables("runs", day_runs=_DAY_RUNS, body=_RATES))
def throughput(spark, sf_dir):
    return _rates(spark, sf_dir)


@query(
    "throughput_verdict",
    t.with_tables(
        "runs",
        day_runs=_DAY_RUNS,
        rates=_RATES,
        body="""SELECT *, CASE WHEN mb_s IS NULL THEN 'UNKNOWN' WHEN mb_s >= 3 THEN 'PASS'
                  WHEN mb_s >= 2 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM rates""",
    ),
)
def throughput_verdict(spark, sf_dir):
    return ops.throughput_verdict(_rates(spark, sf_dir))


@query(
    "dedup_stats",
    """SELECT l_orderkey AS run_id, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS processed,
         CAST(sum(CAST(l_quantity AS BIGINT) * 1000) AS BIGINT) AS added,
         CAST(sum(CAST(l_quantity AS BIGINT) * 700) AS BIGINT) AS packed,
         CAST(printf('%.3f', sum(CAST(l_quantity AS BIGINT) * 700) / sum(CAST(round(l_extendedprice * 100) AS BIGINT))) AS DOUBLE) AS ratio
       FROM lineitem GROUP BY l_orderkey""",
)
def dedup_stats(spark, sf_dir):
    summaries = t.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("total_bytes_processed"),
        (F.col("l_quantity").cast("bigint") * 1000).alias("data_added"),
        (F.col("l_quantity").cast("bigint") * 700).alias("data_added_packed"),
    )
    return ops.dedup_stats(summaries)


@query(
    "integrity_verdict",
    t.with_tables(
        "log_lines",
        checks="SELECT run_id, CAST(min(k) % 2 AS INT) AS exit_code FROM log_lines GROUP BY run_id",
        errs="""SELECT run_id, max_by(bytes_done, line_no) AS n FROM log_lines
                WHERE readable AND message_type = 'summary' AND bytes_done IS NOT NULL GROUP BY run_id""",
        body="""SELECT run_id, exit_code, coalesce(n, CASE WHEN exit_code = 0 THEN 0 END) AS errors,
                  CASE WHEN exit_code = 0 AND coalesce(n, 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict
                FROM checks LEFT JOIN errs USING (run_id)""",
    ),
)
def integrity_verdict(spark, sf_dir):
    checks = (
        t.events(spark, sf_dir)
        .groupBy(F.col("user_id").alias("run_id"))
        .agg((F.min(t.k_of()) % 2).cast("int").alias("exit_code"))
    )
    errors = ev.last_event_value(_log(spark, sf_dir), "summary", "bytes_done")
    return ops.integrity_verdict(checks, errors)


@query(
    "resume_cost",
    """SELECT *, CASE WHEN first_bytes > 0 THEN CAST(printf('%.1f', resume_bytes / first_bytes * 100) AS DOUBLE) END AS reupload_pct,
         CASE WHEN reupload_pct IS NULL THEN 'WARN' WHEN reupload_pct < 25 THEN 'PASS'
           WHEN reupload_pct < 50 THEN 'WARN' ELSE 'FAIL' END AS verdict
       FROM (SELECT user_id AS pair_id,
           max(CASE WHEN event_type = 'error' THEN CAST(round(value * 1000000) AS BIGINT)
                 * CASE WHEN value > 100 THEN 1 ELSE 2 END END) AS first_bytes,
           coalesce(max(CASE WHEN event_type = 'purchase' AND value > 60
             THEN CAST(round(value * 1000000) AS BIGINT) END), 0) AS resume_bytes
         FROM events GROUP BY user_id)""",
)
def resume_cost(spark, sf_dir):
    size = t.bytes_of()
    roles = {"error": "interrupted", "purchase": "resume"}
    runs = t.events(spark, sf_dir).select(
        F.col("user_id").alias("pair_id"),
        t.case_of(F.col("event_type"), roles).alias("role"),
        F.when(
            F.col("value") > F.when(F.col("event_type") == "error", 100).otherwise(60), size
        ).alias("data_added"),
        (size * 2).alias("bytes_done"),
    )
    return ops.resume_cost(runs)


@query(
    "run_summary",
    t.with_tables(
        "reports",
        body="""SELECT mode, status, failure_code, GROUPING(mode, status, failure_code) AS level,
                  count(*) AS runs, round(count(*) FILTER (status = 'success') / count(*), 4) AS success_share,
                  quantile_disc(duration_ms, 0.5) AS duration_p50_ms,
                  quantile_disc(duration_ms, 0.95) AS duration_p95_ms,
                  CAST(sum(failed_files) AS BIGINT) AS failed_files
                FROM reports GROUP BY ROLLUP (mode, status, failure_code)""",
    ),
)
def run_summary(spark, sf_dir):
    return ops.run_summary(
        t.reports(spark, sf_dir), ["mode", "status", "failure_code"], accuracy=1_000_000
    )


@query(
    "run_summary_cube",
    t.with_tables(
        "reports",
        body="""SELECT mode, status, failure_code, GROUPING(mode, status, failure_code) AS level,
                  count(*) AS runs, round(count(*) FILTER (status = 'success') / count(*), 4) AS success_share,
                  CAST(sum(failed_files) AS BIGINT) AS failed_files, true AS p50_close, true AS p95_close
                FROM reports GROUP BY CUBE (mode, status, failure_code)""",
    ),
)
def run_summary_cube(spark, sf_dir):
    """Sketches of the finest groups merged upwards; percentiles lie between exact ones two percent off."""
    dims, reports = ["mode", "status", "failure_code"], t.reports(spark, sf_dir)
    summary = ops.summary_of(ops.run_sketches(reports, dims), dims)
    near = {f"{n}_{k}": q for n, qs in (("p50", (0.48, 0.52)), ("p95", (0.93, 0.97))) for k, q in enumerate(qs)}
    exact = reports.cube(*dims).agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.percentile_approx("duration_ms", list(near.values()), 1_000_000).alias("near"),
    ).select(*dims, "level", *[F.col("near")[k].alias(n) for k, n in enumerate(near)])
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"e.{c}")) for c in [*dims, "level"]]
    both = summary.alias("s").join(exact.alias("e"), same)
    return both.select(
        *[F.col(f"s.{c}") for c in [*dims, "level", "runs", "success_share", "failed_files"]],
        *[F.col(f"s.duration_{n}_ms").between(F.col(f"{n}_0"), F.col(f"{n}_1")).alias(f"{n}_close") for n in ("p50", "p95")],
    )


COUNTERS = [
    ("scannedFiles", "l_linenumber", 3),
    ("selectedFiles", "l_linenumber", 2),
    ("uploadedFiles", "l_linenumber", 1),
    ("downloadedFiles", "l_quantity", 1),
    ("failedFiles", "l_quantity", 2),
    ("verifiedFiles", "l_quantity", 3),
    ("verifyFailedFiles", "l_quantity", 4),
    ("deletedRemoteFiles", "l_suppkey", 1),
    ("retriedOperations", "l_suppkey", 2),
]


@query(
    "wide_counts_total",
    " UNION ALL ".join(
        f"SELECT '{n}' AS counter, CAST(sum(CAST({c} AS BIGINT) * {m}) AS BIGINT) AS total FROM lineitem"
        for n, c, m in COUNTERS
    ),
)
def wide_counts_total(spark, sf_dir):
    reports = t.table(spark, sf_dir, "lineitem").select(
        *[(F.col(c).cast("bigint") * m).alias(n) for n, c, m in COUNTERS]
    )
    return ops.wide_counts_total(reports)


VERDICTS = {"error": "FAIL", "signup": "WARN", "view": "INFO"}


@query(
    "verdict_gate",
    f"""SELECT host, count(*) FILTER (v = 'PASS') AS passed, count(*) FILTER (v = 'FAIL') AS failed,
          count(*) FILTER (v = 'WARN') AS warned,
          CASE WHEN count(*) FILTER (v = 'FAIL') = 0 THEN 'PASS' ELSE 'FAIL' END AS gate
        FROM (SELECT date_trunc('hour', ts) AS host, {t.case_sql("event_type", VERDICTS, "PASS")} AS v FROM events)
        GROUP BY host""",
)
def verdict_gate(spark, sf_dir):
    ledger = t.events(spark, sf_dir).select(
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("host"),
        t.case_of(F.col("event_type"), VERDICTS, "PASS").alias("verdict"),
    )
    return ops.verdict_gate(ledger, ["host"])


@query(
    "ledger_union",
    f"""SELECT event_type AS test, {t.case_sql("event_type", VERDICTS, "PASS")} AS verdict, value AS seconds,
          CAST(NULL AS BIGINT) AS run_id FROM events
        UNION ALL SELECT 'report', CASE WHEN o_orderstatus = 'F' THEN 'PASS' ELSE 'FAIL' END, NULL, o_orderkey
        FROM orders""",
)
def ledger_union_query(spark, sf_dir):
    first = t.events(spark, sf_dir).select(
        F.col("event_type").alias("test"),
        t.case_of(F.col("event_type"), VERDICTS, "PASS").alias("verdict"),
        F.col("value").alias("seconds"),
    )
    second = t.table(spark, sf_dir, "orders").select(
        F.lit("report").alias("test"),
        F.when(F.col("o_orderstatus") == "F", "PASS").otherwise("FAIL").alias("verdict"),
        F.col("o_orderkey").alias("run_id"),
    )
    return ledger_union(first, second)


_BASE = """SELECT *, last_value(CASE WHEN status = 'success' THEN
    {'run_id': run_id, 'at': started_at, 'files': files, 'bytes': bytes} END IGNORE NULLS) OVER (
    PARTITION BY source ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
  FROM runs"""


@query(
    "baseline_asof",
    t.with_tables(
        "runs",
        based=_BASE,
        body="""SELECT run_id, source, started_at, status, files, bytes, b.run_id AS baseline_run_id,
                  b.at AS baseline_at, b.files AS baseline_files, b.bytes AS baseline_bytes FROM based""",
    ),
)
def baseline_asof(spark, sf_dir):
    return ops.baseline_asof(t.runs(spark, sf_dir).drop("finished_at"), chunk="day")


@query(
    "sanity_band",
    t.with_tables(
        "runs",
        "bands",
        based=_BASE,
        judged="""SELECT run_id, source, concat_ws(',',
            CASE WHEN files < min_files THEN 'below_min_files' END,
            CASE WHEN bytes < min_bytes THEN 'below_min_bytes' END,
            CASE WHEN b.bytes > 0 AND (b.bytes - bytes) * 100.0::DOUBLE / b.bytes > max_shrink_pct THEN 'bytes_shrunk' END,
            CASE WHEN b.files > 0 AND (b.files - files) * 100.0::DOUBLE / b.files > max_shrink_pct THEN 'files_shrunk' END
          ) AS reasons FROM based LEFT JOIN bands USING (source)""",
        body="SELECT run_id, source, reasons, reasons <> '' AS abort FROM judged",
    ),
)
def sanity_band(spark, sf_dir):
    out = ops.sanity_band(t.runs(spark, sf_dir), t.bands(spark, sf_dir), chunk="day")
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query(
    "overlapping_runs",
    t.with_tables(
        "runs",
        busy="""SELECT *, max({'e': finished_at, 'r': run_id}) OVER (PARTITION BY source
                  ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM runs""",
        body="""SELECT source AS repo, run_id, started_at, b.r AS blocking_run_id, b.e AS busy_until
                FROM busy WHERE b.e > started_at""",
    ),
)
def overlapping_runs(spark, sf_dir):
    runs = t.runs(spark, sf_dir).withColumnRenamed("source", "repo")
    return ops.overlapping_runs(runs, chunk="day")


@query(
    "staleness",
    t.with_tables(
        "runs",
        last="SELECT source, max(finished_at) FILTER (status = 'success') AS last_success FROM runs GROUP BY source",
        body="""SELECT source, last_success,
                  CAST(floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last_success)) / 3600000000) AS BIGINT) AS hours,
                  CASE WHEN last_success IS NULL THEN 'never'
                    WHEN epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last_success) > 24 * 3600000000 THEN 'stale'
                    ELSE 'current' END AS state FROM last""",
    ),
)
def staleness(spark, sf_dir):
    return ops.staleness(t.runs(spark, sf_dir), F.lit(NOW), 24)


@query(
    "group_errors",
    """SELECT error, count(*) AS failures, string_agg(path, ',' ORDER BY path) FILTER (rn <= 3) AS sample,
         greatest(count(*) - 3, 0) AS more
       FROM (SELECT error, path, row_number() OVER (PARTITION BY error ORDER BY path) AS rn FROM (
         SELECT 'code ' || CAST(l_suppkey % 40 AS VARCHAR) AS error,
           '/data/' || l_orderkey || '/' || l_linenumber || '/' || l_partkey AS path
         FROM lineitem))
       GROUP BY error""",
)
def group_errors(spark, sf_dir):
    path = F.concat_ws(
        "/", F.lit("/data"), *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]
    )
    failures = (
        t.table(spark, sf_dir, "lineitem")
        .select(
            F.concat(F.lit("code "), (F.col("l_suppkey") % 40).cast("string")).alias("error"),
            path.alias("path"),
        )
    )
    return ops.group_errors(failures).withColumn("sample", F.array_join("sample", ","))


@query(
    "progress_eta",
    """WITH p AS (SELECT user_id AS run_id, event_id, ts, event_id * 1000000 AS bytes_done,
           CAST(200000000000 AS BIGINT) AS total_bytes FROM events),
         w AS (SELECT *, first_value(ts) OVER f AS ts0, first_value(bytes_done) OVER f AS b0 FROM p
           WINDOW f AS (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
         r AS (SELECT *, CASE WHEN epoch_us(ts) > epoch_us(ts0)
           THEN CAST(bytes_done - b0 AS DOUBLE) * 1000000 / (epoch_us(ts) - epoch_us(ts0)) END AS x FROM w)
       SELECT run_id, event_id, ts, bytes_done, total_bytes, round(x, 2) AS rate,
         CASE WHEN x > 0 THEN CAST(ceil((total_bytes - bytes_done) / x) AS BIGINT) END AS eta_s FROM r""",
)
def progress_eta(spark, sf_dir):
    progress = t.events(spark, sf_dir).select(
        F.col("user_id").alias("run_id"),
        "event_id",
        "ts",
        (F.col("event_id") * 1_000_000).alias("bytes_done"),
        F.lit(200_000_000_000).cast("bigint").alias("total_bytes"),
    )
    return ops.progress_eta(progress, 5, chunk="day")


@query(
    "rank_sources",
    """WITH s AS (SELECT o_custkey AS source, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS total
         FROM orders GROUP BY 1)
       SELECT source, total, rank() OVER (ORDER BY total DESC) AS rank,
         percent_rank() OVER (ORDER BY total DESC) AS percent_rank,
         CAST(ntile(10) OVER (ORDER BY total DESC, source) AS INT) AS tile,
         round(total / sum(total) OVER (), 6) AS share,
         CAST(sum(total) OVER (ORDER BY total DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running
       FROM s""",
)
def rank_sources(spark, sf_dir):
    runs = t.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("source"), F.round("o_totalprice").cast("bigint").alias("bytes")
    )
    return ops.rank_sources(runs)


@query(
    "top_failing",
    """SELECT l_suppkey AS source, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS failed_files
       FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def top_failing(spark, sf_dir):
    reports = (
        t.table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_suppkey").alias("source"), F.col("l_quantity").cast("bigint").alias("failed_files")
        )
    )
    return ops.top_failing(reports, 10)


@query(
    "project_seed",
    t.with_tables(
        "runs",
        totals="SELECT source, CAST(sum(bytes) AS BIGINT) * 10000 AS bytes FROM runs GROUP BY source",
        rates="""SELECT source, started_at, CAST(printf('%.2f', CAST(bytes * 10 AS DOUBLE)
                   / floor((epoch_us(finished_at) - epoch_us(started_at)) / 1000000) / 1000000) AS DOUBLE) AS mb_s FROM runs""",
        latest="SELECT source, max_by(mb_s, (started_at, mb_s)) AS mb_s FROM rates GROUP BY source",
        body="""SELECT source, bytes, mb_s,
                  CASE WHEN mb_s > 0 THEN CAST(printf('%.1f', bytes / (mb_s * 1000000) / 86400) AS DOUBLE) END AS days
                FROM totals LEFT JOIN latest USING (source)""",
    ),
)
def project_seed(spark, sf_dir):
    runs = t.runs(spark, sf_dir)
    totals = inventory_totals(runs.select("source", "bytes")).withColumn(
        "bytes", F.col("bytes") * 10_000
    )
    rates = _rates(spark, sf_dir).join(
        runs.select("run_id", "source", F.col("started_at").alias("measured_at")), "run_id"
    )
    return ops.project_seed(totals, rates)


@query(
    "pack_plan",
    """SELECT source, files, bytes, pack_mib, CAST(ceil(bytes / (pack_mib * 1048576.0::DOUBLE)) AS BIGINT) AS objects,
         CAST(printf('%.1f', objects * 30.0::DOUBLE / 4 / 86400) AS DOUBLE) AS metadata_days,
         CAST(printf('%.1f', bytes / 5000000.0::DOUBLE / 86400) AS DOUBLE) AS transfer_days,
         CASE WHEN objects * 30.0::DOUBLE / 4 > bytes / 5000000.0::DOUBLE THEN 'metadata' ELSE 'bandwidth' END AS bottleneck,
         CAST(pack_mib AS BIGINT) * 1048576 * 5 AS temp_bytes
       FROM (SELECT o_custkey AS source, count(*) AS files,
           CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) * 500000 AS bytes FROM orders GROUP BY 1),
         (VALUES (16), (64), (128)) AS p(pack_mib)""",
)
def pack_plan(spark, sf_dir):
    inventory = t.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("source"), F.round("o_totalprice").cast("bigint").alias("bytes")
    )
    totals = inventory_totals(inventory).withColumn("bytes", F.col("bytes") * 500_000)
    return ops.pack_plan(totals)


_EXPECTED = """fired AS (
  SELECT job, d + to_hours(CAST(h AS BIGINT)) + to_minutes(CAST(m AS BIGINT)) AS fire_at, job % 4 AS kind, d, h, m
  FROM (SELECT DISTINCT user_id AS job FROM events),
    (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS d),
    (SELECT unnest(range(24)) AS h), (SELECT unnest([0, 15, 30, 45]) AS m)),
  expected AS (SELECT job, fire_at FROM fired WHERE
    (kind = 0 AND h = 2 AND m = 0)
    OR (kind = 1 AND h % 6 = 0 AND m = 30 AND dayofweek(d) BETWEEN 1 AND 5)
    OR (kind = 2 AND h = 5 AND m = 0 AND dayofweek(d) = 0)
    OR (kind = 3 AND h IN (3, 4) AND m IN (15, 45) AND day(d) IN (1, 15)))"""


def _expected(spark, sf_dir):
    jobs = t.events(spark, sf_dir).select(F.col("user_id").alias("job")).distinct()
    return schedule.expected_runs(
        jobs.withColumn("cron", t.pick(F.col("job"), CRONS)), *HORIZON
    )


@query("expected_runs", f"WITH {_EXPECTED} SELECT job, fire_at FROM expected")
def expected_runs(spark, sf_dir):
    return _expected(spark, sf_dir).withColumn("fire_at", F.col("fire_at").cast("timestamp_ntz"))


@query(
    "missed_runs",
    f"""WITH {_EXPECTED} SELECT job, fire_at FROM expected e WHERE NOT EXISTS (
          SELECT 1 FROM events r WHERE r.user_id = e.job AND r.ts BETWEEN e.fire_at AND e.fire_at + INTERVAL 600 MINUTE)""",
)
def missed_runs(spark, sf_dir):
    runs = t.runs(spark, sf_dir).select(F.col("source").alias("job"), "started_at")
    return schedule.missed_runs(_expected(spark, sf_dir), runs, 600).withColumn(
        "fire_at", F.col("fire_at").cast("timestamp_ntz")
    )
