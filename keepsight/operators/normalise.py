"""Text columns to numbers, with a quarantine for what cannot be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsight.functions.units import parse_duration, parse_size, timetable_entries


def _split(df: DataFrame, parsed: Column) -> tuple[DataFrame, DataFrame]:
    rows = df.withColumn("_p", parsed)
    keep = [F.col(c) for c in df.columns]
    good = rows.filter(F.col("_p.reason").isNull()).select(*keep, F.col("_p.value").alias("value"))
    bad = rows.filter(F.col("_p.reason").isNotNull()).select(
        *keep, F.col("_p.reason").alias("reason")
    )
    return good, bad


def normalise_sizes(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)``: rows with ``value`` in bytes, and rows with a ``reason``."""
    return _split(df, parse_size(F.col(col)))


def normalise_durations(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)``: rows with ``value`` in milliseconds, and rows with a ``reason``."""
    return _split(df, parse_duration(F.col(col)))


def timetable_audit(df: DataFrame, col: str) -> DataFrame:
    """One row per timetable entry: ``pos``, ``hhmm``, ``rate`` and ``error`` (null if valid)."""
    return df.select("*", F.posexplode(timetable_entries(F.col(col))).alias("pos", "_e")).select(
        *df.columns, "pos", "_e.hhmm", "_e.rate", "_e.error"
    )
