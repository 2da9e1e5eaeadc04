"""Scans and sinks: each query writes files derived from a table and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsight.plans import tables as t
from keepsight.plans.history import VERDICTS
from keepsight.plans.registry import query
from keepsight.sources import readers, writers
from keepsight.sources.shared import shared_path


def _written_log(spark, sf_dir) -> str:
    path = shared_path(spark, "event_log")
    t.log_lines(spark, sf_dir).select("value").write.text(path)
    return path


@query(
    "scan_event_log",
    t.with_tables(
        "log_lines",
        body="""SELECT run_id AS run, line_no AS line, message_type,
                  CASE WHEN is_false THEN 'false' WHEN NOT is_null THEN CAST(bytes_done AS VARCHAR) END AS bytes_done,
                  NULL AS raw
                FROM log_lines WHERE readable
                UNION ALL SELECT NULL, NULL, NULL, NULL,
                  CASE WHEN k >= 95 THEN 'NOTICE: line ' || line_no
                    ELSE substr('{"message_type":"' || message_type || '","run":', 1, 24) END
                FROM log_lines WHERE NOT readable""",
    ),
)
def scan_event_log(spark, sf_dir):
    events, rejects = readers.scan_event_log(spark, _written_log(spark, sf_dir))
    typed = events.select(
        *[
            F.try_variant_get("event", f"$.{name}", kind).alias(name)
            for name, kind in (
                ("run", "bigint"), ("line", "bigint"), ("message_type", "string"), ("bytes_done", "string"),
            )
        ]
    )
    return typed.unionByName(rejects.select("raw"), allowMissingColumns=True)


def _report_lines(spark, sf_dir):
    """Orders as report documents; some break the schema."""
    order, key = F.col("o_orderstatus"), F.col("o_orderkey")
    counts = F.struct(
        *[
            (key % 100 + i).alias(name)
            for i, name in enumerate(
                ["scannedFiles", "selectedFiles", "uploadedFiles", "downloadedFiles", "failedFiles",
                 "verifiedFiles", "verifyFailedFiles", "deletedRemoteFiles"]
            )
        ]
    )
    when = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    report = F.struct(
        F.when(F.col("o_totalprice") > 450_000, "2.0.0").otherwise("1.0.0").alias("schemaVersion"),
        F.concat(F.lit("run-"), key.cast("string")).alias("runId"),
        F.when(F.col("o_totalprice") < 20_000, "sync").otherwise("backup").alias("mode"),
        t.case_of(order, t.REPORT_STATUS).alias("status"),
        when.alias("startedAt"),
        when.alias("finishedAt"),
        (F.round(F.col("o_totalprice") * 100).cast("bigint") - 3_000_000).alias("durationMs"),
        F.struct(
            F.array(F.lit("backup"), F.lit("--all")).alias("argv"), F.lit("0.4.0").alias("version")
        ).alias("command"),
        F.struct(F.lit("/data").alias("source"), F.lit("/vault").alias("target")).alias("paths"),
        counts.alias("counts"),
        F.lit(0).alias("exitCode"),
        t.case_of(order, t.REPORT_FAILURE).alias("failureCode"),
        F.struct(
            F.lit("/state/m").alias("manifestPath"), F.lit("/state/l").alias("logPath")
        ).alias("artifacts"),
    )
    line = F.to_json(report)
    extra = F.concat(F.lit('{"surplus":true,'), F.substr(line, F.lit(2)))
    return t.table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderpriority") == "5-LOW", extra).otherwise(line).alias("value")
    )


def _scanned_reports(spark, sf_dir):
    path = shared_path(spark, "run_reports")
    _report_lines(spark, sf_dir).write.text(path)
    return readers.scan_run_reports(spark, path)


@query(
    "scan_run_reports",
    """SELECT 'run-' || o_orderkey AS run_id, o_orderdate AS started_at,
         CAST(round(o_totalprice * 100) AS BIGINT) - 3000000 AS duration_ms, o_orderkey % 100 + 4 AS failed_files
       FROM orders WHERE o_totalprice <= 450000 AND o_totalprice >= 30000 AND o_orderpriority <> '5-LOW'""",
)
def scan_run_reports(spark, sf_dir):
    reports, _ = _scanned_reports(spark, sf_dir)
    return reports.select(
        F.col("runId").alias("run_id"),
        F.col("startedAt").cast("timestamp_ntz").alias("started_at"),
        F.col("durationMs").alias("duration_ms"),
        F.col("counts.failedFiles").alias("failed_files"),
    )


@query(
    "scan_run_reports_violations",
    """SELECT path, rule, count(*) AS reports FROM (
         SELECT 'schemaVersion' AS path, 'enum' AS rule FROM orders WHERE o_totalprice > 450000
         UNION ALL SELECT 'mode', 'enum' FROM orders WHERE o_totalprice < 20000
         UNION ALL SELECT 'durationMs', 'min' FROM orders WHERE CAST(round(o_totalprice * 100) AS BIGINT) < 3000000
         UNION ALL SELECT 'config.surplus', 'unknown_key' FROM orders WHERE o_orderpriority = '5-LOW')
       GROUP BY path, rule""",
)
def scan_run_reports_violations(spark, sf_dir):
    _, violations = _scanned_reports(spark, sf_dir)
    return violations.groupBy("path", "rule").agg(F.count(F.lit(1)).alias("reports"))


@query(
    "scan_manifest",
    t.with_tables("contents", body="SELECT path, sha256, 'source' AS side FROM contents"),
)
def scan_manifest(spark, sf_dir):
    path = shared_path(spark, "manifest")
    lines = t.contents(spark, sf_dir).select(F.concat_ws("  ", "sha256", "path").alias("value"))
    lines.write.text(path)
    return readers.scan_manifest(spark, path, "source")


@query("scan_file_inventory")
def scan_file_inventory(spark, sf_dir):
    """The table files themselves; only their metadata is read."""
    files = readers.scan_file_inventory(spark, sf_dir, glob="*.parquet")
    return files.select(readers.file_stem(F.col("path")).alias("name"), "bytes")


@query(
    "scan_quota_history",
    t.with_tables(
        "quota",
        body="""SELECT CASE WHEN used IS NOT NULL THEN total END AS total, used,
                  CASE WHEN used IS NOT NULL THEN total - used END AS free FROM quota""",
    ),
)
def scan_quota_history(spark, sf_dir):
    path = shared_path(spark, "quota")
    readings = t.quota(spark, sf_dir)
    known = F.struct("total", "used", (F.col("total") - F.col("used")).alias("free"))
    line = F.when(F.col("used").isNotNull(), F.to_json(known)).otherwise(F.lit("{}"))
    readings.select(line.alias("value")).write.text(path)
    return readers.scan_quota_history(spark, path).select("total", "used", "free")


@query(
    "append_ledger",
    f"""SELECT event_type AS test, {t.case_sql("event_type", VERDICTS, "PASS")} AS verdict,
          'event ' || event_id AS message, CAST(ts AS DATE) AS run_date FROM events""",
)
def append_ledger(spark, sf_dir):
    path = shared_path(spark, "ledger")
    ledger = t.events(spark, sf_dir).select(
        F.col("event_type").alias("test"),
        t.case_of(F.col("event_type"), VERDICTS, "PASS").alias("verdict"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"),
        F.to_date("ts").alias("run_date"),
    )
    passed = F.col("verdict").isin("PASS", "INFO")
    for part in (ledger.filter(passed), ledger.filter(~passed)):
        writers.append_ledger(part, path)
    return readers.scan_ledger(spark, path).drop("detail")


@query(
    "append_history",
    t.with_tables("reports", body="SELECT run_id, source, mode, status, duration_ms FROM reports"),
)
def append_history(spark, sf_dir):
    path = shared_path(spark, "history")
    reports = t.reports(spark, sf_dir).select("run_id", "source", "mode", "status", "duration_ms")
    for mode in t.MODES:
        writers.append_history(reports.filter(F.col("mode") == mode), path)
    return spark.read.parquet(path)
