"""Append-only sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

VERDICTS = ("PASS", "FAIL", "WARN", "INFO")


def append_ledger(ledger: DataFrame, path: str) -> None:
    """Append verdict rows, in directories by ``run_date``; an unknown verdict stops the write.

    Rows are rebalanced by date first: a date lands in few files, and a date with
    very many rows is still split over several tasks.
    """
    allowed = F.col("verdict").isin(*VERDICTS)
    checked = ledger.withColumn(
        "verdict",
        F.when(allowed, F.col("verdict")).otherwise(
            F.raise_error(F.concat(F.lit("unknown verdict: "), F.coalesce("verdict", F.lit("null"))))
        ),
    )
    checked.hint("rebalance", "run_date").write.mode("append").partitionBy("run_date").json(path)


def append_history(reports: DataFrame, path: str) -> None:
    """Append run reports to the history table."""
    reports.write.mode("append").parquet(path)


def stream_history(reports: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of run reports to the history table, exactly once, then stop."""
    return (
        reports.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
