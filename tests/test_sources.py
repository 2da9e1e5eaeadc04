"""Readers and writers on real files."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from keepsight.operators import events as ev
from keepsight.operators import inventory as inv
from keepsight.operators import runs as ops
from keepsight.sources import readers, writers

STATUS = ['{"message_type":"status","percent_done":0.5,"bytes_done":123}',
          '{"message_type":"status","percent_done":0.9,"bytes_done":456}']
SUMMARY = (
    '{"message_type":"summary","total_bytes_processed":21474836480,"data_added":10737418240,'
    '"data_added_packed":8589934592,"total_files_processed":1234,"snapshot_id":"abc123"}'
)
CUT = '{"message_type":"stat'
LOGS = {
    "clean": [*STATUS, SUMMARY],
    "truncated": ['{"message_type":"status","bytes_done":789}', CUT],
    "leading": ["NOTICE: some warning", *STATUS, SUMMARY],
    "interleaved": [STATUS[0], "NOTICE: interleaved", STATUS[1], SUMMARY],
    "tail": [*STATUS, SUMMARY, CUT],
    "later_null": [*STATUS, SUMMARY, '{"message_type":"summary","data_added_packed":null,"snapshot_id":false}'],
    "scalars": ["5", "[1]", '"text"', "", *STATUS, SUMMARY],
}


@pytest.fixture
def logs(tmp_path):
    for name, lines in LOGS.items():
        (tmp_path / f"{name}.ndjson").write_text("\n".join(lines))
    return str(tmp_path)


def last(events, kind, field):
    return {r["run_id"]: r["value"] for r in ev.last_event_value(events, kind, field).collect()}


def test_event_log(spark, logs):
    events, rejects = readers.scan_event_log(spark, logs)
    full = set(LOGS) - {"truncated"}
    assert last(events, "summary", "data_added_packed") == dict.fromkeys(full, "8589934592")
    assert last(events, "summary", "snapshot_id") == dict.fromkeys(full, "abc123")
    assert last(events, "status", "bytes_done") == {**dict.fromkeys(full, "456"), "truncated": "789"}
    assert last(events, "summary", "nope") == last(events, "nope", "bytes_done") == {}
    raw = sorted(r["raw"] for r in rejects.collect())
    assert raw == sorted(["", '"text"', "5", "[1]", CUT, CUT, "NOTICE: interleaved", "NOTICE: some warning"])


def test_line_order_holds_across_splits(spark, tmp_path):
    lines = [f'{{"message_type":"status","bytes_done":{i + 1}}}' for i in range(20_000)]
    (tmp_path / "run.ndjson").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        events, _ = readers.scan_event_log(spark, str(tmp_path))
        assert events.rdd.getNumPartitions() > 3
        assert last(events, "status", "bytes_done") == {"run": "20000"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def report(**changes):
    base = {
        "schemaVersion": "1.0.0", "runId": "r1", "mode": "backup", "status": "success",
        "startedAt": "2026-03-23T01:20:00Z", "finishedAt": "2026-03-23T01:20:19Z", "durationMs": 19000,
        "command": {"argv": ["x"], "version": "0.4.0"},
        "paths": {"source": "/s", "target": "/t", "pathFilter": None},
        "counts": dict.fromkeys(readers.REPORT_COUNTS, 4), "exitCode": 0, "failureCode": "none",
        "warnings": [], "failedPaths": [], "artifacts": {"manifestPath": "m", "logPath": None},
    }
    base.update(changes)
    return {k: v for k, v in base.items() if v is not ...}


def test_run_reports(spark, tmp_path):
    counts = dict.fromkeys(readers.REPORT_COUNTS, 4)
    bad = {
        "schemaVersion": (report(schemaVersion="2.0.0"), "enum"),
        "mode": (report(mode="sync"), "enum"),
        "failureCode": (report(failureCode="oops"), "enum"),
        "counts.failedFiles": (report(counts={**counts, "failedFiles": -1}), "min"),
        "runId": (report(runId=...), "required"),
        "config.extra": (report(extra=1), "unknown_key"),
        "paths.more": (report(paths={"source": "/s", "target": "/t", "more": 1}), "unknown_key"),
        "durationMs": (report(durationMs=1.5), "type"),
    }
    lines = [json.dumps(report()), json.dumps(report(runId="r2", status="dry-run")), "{oops"]
    lines += [json.dumps(doc) for doc, _ in bad.values()]
    (tmp_path / "history.ndjson").write_text("\n".join(lines))
    reports, violations = readers.scan_run_reports(spark, str(tmp_path))
    assert sorted(r["runId"] for r in reports.collect()) == ["r1", "r2"]
    assert reports.first()["counts"]["scannedFiles"] == 4
    expected = {(path, rule) for path, (_, rule) in bad.items()} | {("", "json")}
    assert {(r["path"], r["rule"]) for r in violations.collect()} == expected


def test_report_values_are_read_or_refused(spark, tmp_path):
    counts = dict.fromkeys(readers.REPORT_COUNTS, 4)
    bad = {
        "startedAt": report(startedAt="yesterday"),
        "finishedAt": report(finishedAt="2024-02-30T00:00:00Z"),
        "durationMs": report(durationMs=10**30),
        "exitCode": report(exitCode=2**40),
        "counts.scannedFiles": report(counts={**counts, "scannedFiles": 2**70}),
    }
    whole = report(runId="whole", durationMs=2.0, startedAt="2024-01-02T03:04:05+02:00")
    (tmp_path / "r.ndjson").write_text("\n".join(json.dumps(d) for d in [whole, *bad.values()]))
    reports, violations = readers.scan_run_reports(spark, str(tmp_path))
    rows = reports.selectExpr("runId", "durationMs", "unix_seconds(startedAt) AS s", "finishedAt IS NOT NULL AS done").collect()
    assert [tuple(r) for r in rows] == [("whole", 2, 1704157445, True)]
    assert {(r["path"], r["rule"]) for r in violations.collect()} >= {(p, "value") for p in bad}


def test_report_lines_are_judged_once_where_they_lie(spark, tmp_path):
    counts = dict.fromkeys(readers.REPORT_COUNTS, 4)
    docs = [report(), report(), report(counts=5, artifacts=None), report(counts={**counts, "failedFiles": "4"}), [1]]
    (tmp_path / "r.ndjson").write_text("\n".join(json.dumps(d) for d in docs))
    reports, violations = readers.scan_run_reports(spark, str(tmp_path))
    for df in (reports, violations):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and text.count("FileScan text") == 1
    assert [r["runId"] for r in reports.collect()] == ["r1", "r1"]
    found = sorted((r["path"], r["rule"]) for r in violations.collect())
    lost = [(f"counts.{name}", "required") for name in readers.REPORT_COUNTS]
    below = [("artifacts.logPath", "required"), ("artifacts.manifestPath", "required")]
    assert found == sorted([("", "json"), ("counts", "type"), ("artifacts", "type"), ("counts.failedFiles", "type"), *lost, *below])


def test_manifest_and_inventory(spark, tmp_path):
    left, right = tmp_path / "left", tmp_path / "right"
    for side in (left, right):
        (side / "d").mkdir(parents=True)
        (side / "same").write_bytes(b"same")
        (side / "d" / "edit").write_bytes(b"aaaa")
    (right / "d" / "edit").write_bytes(b"bbbb")
    (left / "gone").write_bytes(b"x")
    (right / "new file").write_bytes(b"y")

    def manifest(side):
        lines = [
            f"{hashlib.sha256(f.read_bytes()).hexdigest()}  ./{f.relative_to(side)}"
            for f in sorted(side.rglob("*")) if f.is_file()
        ]
        path = tmp_path / f"{side.name}.sha"
        path.write_text("\n".join([*lines, "not a manifest line"]))
        return str(path)

    a, b = (readers.scan_manifest(spark, manifest(s), s.name) for s in (left, right))
    assert readers.manifest_rejects(spark, str(tmp_path / "left.sha")).count() == 1
    diff = inv.manifest_diff(a, b)
    assert {r["path"]: r["change"] for r in diff.collect()} == {
        "./same": "identical", "./d/edit": "changed", "./gone": "removed", "./new file": "added",
    }
    gate = inv.manifest_gate(diff).first()
    assert (gate["files"], gate["differing"], gate["gate"]) == (4, 3, "FAIL")
    assert inv.manifest_gate(inv.manifest_diff(a, a)).first()["gate"] == "PASS"

    hashed = readers.scan_file_inventory(spark, str(left), hash=True)
    found = {r["path"].rsplit("/left/", 1)[1]: (r["bytes"], r["sha256"]) for r in hashed.collect()}
    assert found == {
        str(f.relative_to(left)): (f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest())
        for f in left.rglob("*") if f.is_file()
    }
    plain = readers.scan_file_inventory(spark, str(left))
    assert "content" not in plain._jdf.queryExecution().executedPlan().toString()


def test_quota_files(spark, tmp_path):
    (tmp_path / "quota-before.json").write_text('{"total":100,"used":60,"free":40}')
    (tmp_path / "quota-after.json").write_text("{}")
    got = {r["label"]: (r["total"], r["used"]) for r in readers.scan_quota_history(spark, str(tmp_path)).collect()}
    assert got == {"before": (100, 60), "after": (None, None)}
    readings = readers.scan_quota_history(spark, str(tmp_path)).withColumn("prune_id", F.lit(1))
    assert ops.quota_reclaim(readings).first()["outcome"] == "unknown"


def test_quota_lines_and_indented_objects_in_one_folder(spark, tmp_path):
    (tmp_path / "quota-lines.json").write_text('{"total":1,"used":1,"free":0}\n{"total":2,"used":1,"free":1}\n\n{"total":3,')
    (tmp_path / "quota-one line.json").write_text('{"total":4,"used":1,"free":3}')
    (tmp_path / "quota-tall.json").write_text('{\n  "total": 5,\n  "used": 2,\n  "free": 3\n}\n')
    (tmp_path / "quota-blank.json").write_text("\n")
    rows = readers.scan_quota_history(spark, str(tmp_path))
    got = sorted(((r["label"], r["total"], r["used"], r["free"]) for r in rows.collect()), key=str)
    assert got == [
        ("lines", 1, 1, 0), ("lines", 2, 1, 1), ("lines", None, None, None), ("one line", 4, 1, 3), ("tall", 5, 2, 3),
    ]
    assert rows.filter("taken_at IS NULL").isEmpty()


def test_ledger_appends_and_refuses_unknown_verdicts(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = lambda *vs: spark.createDataFrame(
        [(f"T{i}", v, "m", "2026-01-01") for i, v in enumerate(vs)], "test string, verdict string, message string, run_date string"
    ).withColumn("run_date", F.to_date("run_date"))
    writers.append_ledger(rows("PASS", "WARN"), path)
    writers.append_ledger(rows("FAIL"), path)
    gate = ops.verdict_gate(readers.scan_ledger(spark, path)).first()
    assert (gate["passed"], gate["failed"], gate["warned"], gate["gate"]) == (1, 1, 1, "FAIL")
    with pytest.raises(Exception, match="unknown verdict"):
        writers.append_ledger(rows("MAYBE"), path)


def test_runs_of_other_folders_and_the_text_false(spark, tmp_path):
    for host, value in (("hostA", '"false"'), ("hostB", "false")):
        (tmp_path / host).mkdir()
        (tmp_path / host / "t2.ndjson").write_text(
            '{"message_type":"summary","v":"abc"}\n\t{"message_type":"summary","v":%s}\n' % value
        )
    events, rejects = readers.scan_event_log(spark, str(tmp_path))
    got = {r["run_id"]: r["value"] for r in ev.last_event_value(events, "summary", "v").collect()}
    assert got == {"hostA/t2": "false", "hostB/t2": "abc"} and rejects.count() == 0


def test_indented_quota_file(spark, tmp_path):
    (tmp_path / "quota-before.json").write_text('{\n  "total": 10,\n  "used": 4,\n  "free": 6\n}\n')
    got = readers.scan_quota_history(spark, str(tmp_path)).collect()
    assert [(r["label"], r["total"], r["used"], r["free"]) for r in got] == [("before", 10, 4, 6)]
