"""Stateless and windowed stream operators; JVM-side but for the search of registered secrets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from keepsight.functions.rates import BYTES_PER_MB, printed
from keepsight.operators.redaction import redact
from keepsight.sources.readers import parse_event_lines, run_name

# Fixed value: how long a repeated message stays suppressed.
SUPPRESS_FOR = "1 second"


def stream_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Stream of ``(run_id, raw, event)``; ``event`` is null where a line is no JSON object."""
    lines = spark.readStream.option("recursiveFileLookup", "true").text(path).select(
        run_name(path).alias("run_id"), F.col("value").alias("raw")
    )
    return parse_event_lines(lines, "raw")


def split_sinks(events_path: str, rejects_path: str) -> Callable:
    """``foreachBatch`` function that writes events and rejects to two tables.

    Each batch is written under its own number, so a batch that runs again after a
    failure replaces its first attempt.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        events = batch.filter(F.col("event").isNotNull()).select(
            "run_id", F.to_json("event").alias("event")
        )
        rejects = batch.filter(F.col("event").isNull()).select("run_id", "raw")
        events.write.mode("overwrite").parquet(f"{events_path}/batch={batch_id}")
        rejects.write.mode("overwrite").parquet(f"{rejects_path}/batch={batch_id}")

    return write


def write_event_log(parsed: DataFrame, path: str) -> StreamingQuery:
    """Drain an event-log stream into ``path/events`` and ``path/rejects``."""
    return (
        parsed.writeStream.foreachBatch(split_sinks(f"{path}/events", f"{path}/rejects"))
        .option("checkpointLocation", f"{path}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def stream_throughput(
    events: DataFrame, window: str, slide: str | None = None, lateness: str = "10 minutes"
) -> DataFrame:
    """Bytes and MB/s per source and event-time window; rows past the watermark are dropped.

    ``events``: ``ts``, ``source``, ``bytes``. Tumbling without ``slide``.
    """
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    seconds = F.unix_timestamp("window.end") - F.unix_timestamp("window.start")
    return (
        events.withWatermark("ts", lateness)
        .groupBy("source", span.alias("window"))
        .agg(F.count(F.lit(1)).alias("events"), F.sum("bytes").alias("bytes"))
        .select(
            "source",
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "events",
            "bytes",
            printed(F.col("bytes") / seconds / BYTES_PER_MB, 4).alias("mb_s"),
        )
    )


def stream_sessions(events: DataFrame, gap: str, lateness: str = "10 minutes") -> DataFrame:
    """Runs as sessions of activity per source: start, duration, events, bytes."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy("source", F.session_window("ts", gap).alias("session"))
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.sum("bytes").alias("bytes"),
            F.min("ts").alias("started_at"),
            F.max("ts").alias("finished_at"),
        )
        .select(
            "source",
            "started_at",
            "finished_at",
            F.floor(
                (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1_000_000
            ).alias("duration_s"),
            "events",
            "bytes",
        )
    )


def stream_suppress_duplicates(
    events: DataFrame, keys: Sequence[str] = ("source", "message"), delay: str = SUPPRESS_FOR
) -> DataFrame:
    """First of each repeated message; repeats within ``delay`` of it are suppressed.

    A message passes again once the watermark has moved past ``delay``.
    """
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def stream_redact(stream: DataFrame, cols: Sequence[str], secrets: Sequence[str] = ()) -> DataFrame:
    """Redact text before it reaches any sink, with values known when the query starts.

    Values that are registered while it runs: ``stream_redact_growing``.
    """
    return redact(stream, cols, secrets)


def stream_redact_growing(
    stream: DataFrame,
    cols: Sequence[str],
    secrets: Callable[[SparkSession], DataFrame],
    write: Callable[[DataFrame, int], None],
) -> DataStreamWriter:
    """Redact each micro-batch with the values registered by then, and hand it to ``write``.

    ``secrets`` reads the table of values (``value``); it is called anew for each batch, so
    files added since are seen. ``write`` gets the batch and its number; a batch that is
    repeated after a failure comes with the same number, and perhaps with more values.
    """

    def each(batch: DataFrame, number: int) -> None:
        write(redact(batch, cols, secrets(batch.sparkSession)), number)

    return stream.writeStream.foreachBatch(each)


def stream_interval_match(
    expected: DataFrame,
    runs: DataFrame,
    tolerance: str,
    lateness: str = "10 minutes",
    job: str = "job",
) -> DataFrame:
    """Firings no run answered within ``tolerance``, emitted once that is certain.

    ``expected``: job, ``fire_at``. ``runs``: job, ``started_at``.
    """
    wanted = expected.select(job, "fire_at").withWatermark("fire_at", lateness)
    starts = runs.select(F.col(job).alias("_job"), "started_at").withWatermark(
        "started_at", lateness
    )
    within: Column = F.col("started_at").between(
        F.col("fire_at"), F.col("fire_at") + F.expr(f"interval {tolerance}")
    )
    return (
        wanted.join(starts, (F.col(job) == F.col("_job")) & within, "left_outer")
        .filter(F.col("_job").isNull())
        .select(job, "fire_at")
    )
