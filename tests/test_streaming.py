"""Streams over several batches: late rows, alerts, and agreement with batch operators."""

from __future__ import annotations

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from keepsight.operators import redaction
from keepsight.streaming import stateful, windows

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)
SCHEMA = "source string, ts timestamp, status string, message string, bytes long"


class Feed:
    """A stream of JSON files, one batch per file."""

    def __init__(self, spark, path, schema=SCHEMA):
        self.spark, self.path, self.n = spark, path, 0
        (path / "in").mkdir(parents=True, exist_ok=True)
        self.stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path / "in"))

    def put(self, *rows):
        text = "\n".join(json.dumps(r, default=str) for r in rows)
        file = self.path / "in" / f"{self.n:03}.json"
        file.write_text(text)
        # files are taken by time; two written at once would have no order
        os.utime(file, (1_700_000_000 + self.n * 10,) * 2)
        self.n += 1

    def drain(self, out, mode="append"):
        """Start from the checkpoint again, so state also has to survive a restart."""
        query = (
            out.writeStream.format("parquet").outputMode(mode)
            .option("path", str(self.path / "out"))
            .option("checkpointLocation", str(self.path / "ck"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return self.spark.read.schema(out.schema).parquet(str(self.path / "out")).collect()


def row(source, hours, status="success", message="m", num_bytes=10):
    return {"source": source, "ts": T0 + hours * HOUR, "status": status, "message": message, "bytes": num_bytes}


def test_rows_past_the_watermark_are_dropped(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.put(row("a", 0.1), row("a", 0.2))
    feed.put(row("a", 5))
    feed.put(row("a", 5.05))  # rows are judged by the watermark of the batch before
    feed.put(row("a", 0.3), row("a", 5.1))  # the first one is hours late
    feed.put(row("a", 20))
    got = feed.drain(windows.stream_throughput(feed.stream, "1 hour", lateness="10 minutes"))
    assert {(r["window_start"].hour, r["events"], r["bytes"]) for r in got} == {(0, 2, 20), (5, 3, 30)}


def test_silence_alerts_once_and_reports_recovery(spark, tmp_path):
    stateful.use_rocksdb(spark)
    feed = Feed(spark, tmp_path)
    out = stateful.stream_silence_alert(feed.stream, 24 * 3_600_000, "1 hour")
    feed.put(row("a", 0), row("b", 0), row("b", 20))
    feed.put(row("a", 30, status="failure"), row("b", 30), row("c", 30))
    feed.drain(out)
    feed.put(row("b", 50), row("c", 50))
    feed.put(row("a", 60), row("b", 60), row("c", 60))
    feed.put(row("b", 80), row("c", 62))
    got = feed.drain(out)
    alerts = sorted((r["source"], (r["at"] - T0) / HOUR, r["alert"]) for r in got)
    assert alerts == [("a", 24.0, "silent"), ("a", 60.0, "recovered")]
    feed.put(row("b", 100))
    got = feed.drain(out)
    assert ("a", 84.0, "silent") in {(r["source"], (r["at"] - T0) / HOUR, r["alert"]) for r in got}
    assert sum(r["alert"] == "silent" and r["source"] == "a" for r in got) == 2


def test_two_gaps_in_one_batch_both_alert(spark, tmp_path):
    stateful.use_rocksdb(spark)
    feed = Feed(spark, tmp_path)
    feed.put(row("a", 0), row("a", 30), row("a", 60), row("x", 61))
    got = feed.drain(stateful.stream_silence_alert(feed.stream, 24 * 3_600_000, "1 minute"))
    alerts = sorted(((r["at"] - T0) / HOUR, r["alert"]) for r in got if r["source"] == "a")
    assert alerts == [(24.0, "silent"), (30.0, "recovered"), (54.0, "silent"), (60.0, "recovered")]


def test_coverage_state_keeps_the_newest_pass_of_each_shard(spark, tmp_path):
    stateful.use_rocksdb(spark)
    feed = Feed(spark, tmp_path, "repo string, shard int, ts timestamp, ok boolean")
    passed = lambda shard, hours, ok=True: {"repo": "r", "shard": shard, "ts": T0 + hours * HOUR, "ok": ok}
    feed.put(passed(1, 1), passed(2, 2, ok=False))
    feed.put(passed(2, 5), passed(1, 3), passed(1, 2))
    got = feed.drain(stateful.stream_cursor(feed.stream, 2), "append")
    assert sorted((r["verified"], r["full_since"]) for r in got if r["full_since"]) == [(2, T0 + 3 * HOUR)]
    assert min(r["verified"] for r in got) == 1


def test_duplicates_are_suppressed_only_within_the_delay(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.put(row("a", 0, message="x"), row("a", 0, message="y"))
    feed.put(row("a", 0.5, message="x"))
    feed.put(row("a", 10, message="z"))
    feed.put(row("a", 10.5, message="z"))  # the watermark has passed: x is forgotten
    feed.put(row("a", 11, message="x"))
    got = feed.drain(windows.stream_suppress_duplicates(feed.stream, delay="1 hour"))
    assert sorted((r["message"], (r["ts"] - T0) / HOUR) for r in got) == [("x", 0.0), ("x", 11.0), ("y", 0.0), ("z", 10.0)]


def test_sessions_close_after_the_gap(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.put(row("a", 0), row("a", 0.4))
    feed.put(row("a", 3), row("b", 3))
    feed.put(row("z", 30))
    got = feed.drain(windows.stream_sessions(feed.stream, "1 hour"))
    assert sorted((r["source"], r["duration_s"], r["events"]) for r in got) == [("a", 0, 1), ("a", 1440, 2), ("b", 0, 1)]


def test_stream_and_batch_redact_alike(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    texts = ["token = abc", "see hunter2hunter2 and me@example.com", "plain"]
    feed.put(*[row("a", i, message=m) for i, m in enumerate(texts)])
    secrets = ["hunter2hunter2", "hunter3hunter3"]
    got = feed.drain(windows.stream_redact(feed.stream, ["message"], secrets))
    df = spark.createDataFrame([(m,) for m in texts], "message string")
    batch = redaction.redact(df, ["message"], secrets).collect()
    assert sorted(r["message"] for r in got) == sorted(r["message"] for r in batch)
    assert "hunter2" not in str(got)


def test_a_secret_added_between_two_batches_is_gone_from_the_second(spark, tmp_path):
    feed, known = Feed(spark, tmp_path), str(tmp_path / "secrets")

    def register(value):
        spark.createDataFrame([(value,)], "value string").write.mode("append").parquet(known)

    def store(batch, number):
        batch.write.mode("overwrite").parquet(str(tmp_path / f"out/{number}"))

    register("hunter2hunter2")
    for turn in range(2):
        feed.put(row("a", turn, message="hunter2hunter2 and hunter3hunter3"), row("b", turn, message="plain"))
        out = windows.stream_redact_growing(feed.stream, ["message"], lambda s: s.read.parquet(known), store)
        out.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        register("hunter3hunter3")
    got = [sorted(r["message"] for r in spark.read.parquet(str(tmp_path / f"out/{k}")).collect()) for k in (0, 1)]
    assert got == [["[redacted] and hunter3hunter3", "plain"], ["[redacted] and [redacted]", "plain"]]


def test_event_log_stream_splits_its_sinks(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "r1.ndjson").write_text('{"message_type":"status"}\nnoise\n{"cut')
    parsed = windows.stream_event_log(spark, str(tmp_path / "logs"))
    windows.write_event_log(parsed, str(tmp_path / "o")).awaitTermination()
    assert [r["event"] for r in spark.read.parquet(str(tmp_path / "o/events")).collect()] == ['{"message_type":"status"}']
    lost = spark.read.parquet(str(tmp_path / "o/rejects"))
    assert sorted(r["raw"] for r in lost.collect()) == ["noise", '{"cut']
    assert {r["run_id"] for r in lost.select(F.col("run_id")).collect()} == {"r1"}
