"""Keyed-state stream operators: silence alerts and verification coverage.

Both need the RocksDB state store; see ``use_rocksdb``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LONG = T.StructType([T.StructField("value", T.LongType())])
_SHARD = T.StructType([T.StructField("shard", T.IntegerType())])


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers lives in RocksDB, on local disk with shared checkpoints."""
    spark.conf.set(_STATE_STORE, _ROCKSDB)


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64")


class _Silence(StatefulProcessor):
    """Remembers the last success of a source and one timer for it. Times in microseconds."""

    def __init__(self, max_age_ms: int) -> None:
        self.max_age = max_age_ms * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_success_us", _LONG)

    def _timer(self, seen: int) -> int:
        """Timers count whole milliseconds; never early."""
        return -(-(seen + self.max_age) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = self.last.get()[0] if self.last.exists() else None
        timers = list(self.handle.listTimers())
        # the timer of the remembered success is gone once its alert went out
        alerted = seen is not None and self._timer(seen) not in timers
        spans = sorted(
            span
            for batch in rows
            for span in zip(_micros(batch["first_at"]), _micros(batch["last_at"]))
        )
        out = []
        for first, last in spans:
            if seen is not None and first - seen > self.max_age:
                if not alerted:
                    out.append((key[0], "silent", seen + self.max_age))
                out.append((key[0], "recovered", first))
            if seen is None or last > seen:
                seen, alerted = int(last), False
        if spans:
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.last.update((seen,))
            if not alerted:
                self.handle.registerTimer(self._timer(seen))
        yield _alerts(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield _alerts([(key[0], "silent", self.last.get()[0] + self.max_age)])

    def close(self) -> None:
        pass


def _alerts(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["source", "alert", "at"])
    out["at"] = pd.to_datetime(out["at"], unit="us")
    return out


def stream_silence_alert(
    runs: DataFrame, max_age_ms: int, lateness: str = "1 hour", source: str = "source"
) -> DataFrame:
    """``(source, alert, at)``: ``silent`` when a source had no success for ``max_age_ms``,
    ``recovered`` at the next success.

    ``runs``: source, ``ts``, ``status``. Successes first shrink to the first and last
    per source and minute, combined map-side, so a busy source stays cheap to
    track. That is exact for any ``max_age_ms`` of a minute or more.
    """
    minutes = (
        runs.filter(F.col("status") == "success")
        .select(source, "ts")
        .withWatermark("ts", lateness)
        .groupBy(source, F.window("ts", "1 minute").alias("w"))
        .agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
        .select(source, F.window_time("w").alias("event_time"), "first_at", "last_at")
    )
    key_type = runs.schema[source].dataType.simpleString()
    return minutes.groupBy(source).transformWithStateInPandas(
        _Silence(max_age_ms),
        f"source {key_type}, alert string, at timestamp",
        "Append",
        "EventTime",
    )


class _Coverage(StatefulProcessor):
    """Last success of each shard of one repository."""

    def __init__(self, shards: int) -> None:
        self.shards = shards

    def init(self, handle) -> None:
        self.passed = handle.getMapState("last_ok_us", _SHARD, _LONG)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            good = batch[batch["ok"]]
            newest = _micros(good["ts"]).groupby(good["shard"]).max()
            for shard, at in newest.items():
                at_key = (int(shard),)
                old = self.passed.getValue(at_key)[0] if self.passed.containsKey(at_key) else None
                self.passed.updateValue(at_key, (int(at) if old is None else max(old, int(at)),))
        times = [value[0] for value in self.passed.values()]
        full = len(times) == self.shards
        yield pd.DataFrame(
            {
                "repo": [key[0]],
                "verified": [len(times)],
                "full_since": pd.to_datetime([min(times) if full else None], unit="us"),
            }
        )

    def close(self) -> None:
        pass


def stream_cursor(verify_runs: DataFrame, shards: int, repo: str = "repo") -> DataFrame:
    """Coverage after each batch: shards verified so far, and the oldest of a full set.

    ``verify_runs``: repo, ``shard``, ``ts``, ``ok``.
    """
    key_type = verify_runs.schema[repo].dataType.simpleString()
    return (
        verify_runs.select(repo, "shard", "ts", "ok")
        .groupBy(repo)
        .transformWithStateInPandas(
            _Coverage(shards),
            f"repo {key_type}, verified bigint, full_since timestamp",
            "Update",
            "None",
        )
    )
