"""When runs should have happened, and which did not."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsight.functions.cron import FIELD_BOUNDS, cron_error, cron_values
from keepsight.operators.skew import salted_join


def schedule_errors(schedules: DataFrame) -> DataFrame:
    """Schedules whose cron text is refused, with the reason."""
    return schedules.withColumn("reason", cron_error(F.col("cron"))).filter(
        F.col("reason").isNotNull()
    )


def expected_runs(schedules: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Firings of each schedule in ``[start, end)``, as UTC times.

    ``schedules``: ``job``, ``cron`` and optionally ``timezone``; a job may have
    several. Firings are worked out once per distinct expression and zone, and
    then given to its jobs; many jobs share one expression. Refused expressions
    yield nothing here; see ``schedule_errors``.
    """
    zone = F.coalesce("timezone", F.lit("UTC")) if "timezone" in schedules.columns else F.lit("UTC")
    jobs = schedules.select("job", "cron", zone.alias("_zone")).distinct()
    # parsed as an aggregate, so that no later filter repeats the parsing per day
    patterns = (
        schedules.select("cron", zone.alias("_zone"))
        .groupBy("cron", "_zone")
        .agg(F.any_value(cron_values(F.col("cron"))).alias("_v"))
        .filter(cron_error(F.col("cron"), F.col("_v")).isNull())
        .select(
            "cron",
            "_zone",
            *[F.get("_v", F.lit(i)).alias(f"_{name}") for i, name in enumerate(FIELD_BOUNDS)],
        )
    )
    # a day of slack on both sides covers any zone offset
    first = F.lit((start - dt.timedelta(days=1)).date())
    last = F.lit((end + dt.timedelta(days=1)).date())
    days = patterns.withColumn("_date", F.explode(F.sequence(first, last))).filter(
        F.array_contains("_month", F.month("_date"))
        & F.array_contains("_day", F.day("_date"))
        & F.array_contains("_weekday", F.dayofweek("_date") - 1)
    )
    at = _at(F.col("_date"), F.col("_h"), F.col("_m"))
    firings = (
        days.withColumn("_h", F.explode("_hour"))
        .withColumn("_m", F.explode("_minute"))
        .select("cron", "_zone", F.to_utc_timestamp(at, F.col("_zone")).alias("fire_at"))
        .filter((F.col("fire_at") >= F.lit(start)) & (F.col("fire_at") < F.lit(end)))
    )
    return (
        salted_join(jobs, firings, ["cron", "_zone"], "inner", ["job"])
        .select("job", "fire_at")
        .distinct()
    )


def _at(date: Column, hour: Column, minute: Column) -> Column:
    return F.timestamp_seconds(
        F.unix_date(date).cast("bigint") * 86_400 + hour * 3600 + minute * 60
    )


def missed_runs(
    expected: DataFrame, runs: DataFrame, tolerance_minutes: int, job: str = "job"
) -> DataFrame:
    """Firings with no run of the job starting within ``[fire_at, fire_at + tolerance]``.

    Firings fall on whole minutes, so runs first shrink to the earliest start per
    job and minute. That is exact: any run in a minute the interval covers whole
    counts, and in the last, partly covered one only the earliest can. A job and
    hour then hold at most 60 rows, whatever the number of runs.
    """
    starts = (
        runs.groupBy(job, F.date_trunc("minute", "started_at").alias("_minute"))
        .agg(F.min(F.col("started_at").cast("timestamp")).alias("_start"))
        .withColumn("_hour", F.date_trunc("hour", "_minute"))
    )
    until = F.col("fire_at") + F.make_dt_interval(mins=F.lit(tolerance_minutes))
    hours = F.sequence(
        F.date_trunc("hour", "fire_at"), F.date_trunc("hour", until), F.expr("interval 1 hour")
    )
    wanted = expected.withColumn("_hour", F.explode(hours))
    met = (
        wanted.join(starts, [job, "_hour"])
        .filter((F.col("_start") >= F.col("fire_at")) & (F.col("_start") <= until))
        .select(job, "fire_at")
        .distinct()
    )
    return expected.join(met, [job, "fire_at"], "left_anti")
