"""Questions about run history: verdicts, baselines, sanity, overlap, staleness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsight.functions.rates import (
    BYTES_PER_MB,
    BYTES_PER_MIB,
    PASS_MB_S,
    PASS_REUPLOAD_PCT,
    SECONDS_PER_DAY,
    WARN_MB_S,
    WARN_REUPLOAD_PCT,
    mb_per_second,
    printed,
    seed_days,
    throughput_verdict_col,
)
from keepsight.operators.order_stats import ntile_of, with_places
from keepsight.operators.skew import DEFAULT_CHUNK, carry_seeds, salted_join, time_chunk

# Run counters of a report, and the quota mark worth a second look.
RUN_COUNTERS = [
    "scannedFiles",
    "selectedFiles",
    "uploadedFiles",
    "downloadedFiles",
    "failedFiles",
    "verifiedFiles",
    "verifyFailedFiles",
    "deletedRemoteFiles",
    "retriedOperations",
]
QUOTA_MARK = 0.70


def throughput(runs: DataFrame, key: str = "run_id") -> DataFrame:
    """MB/s per run from ``bytes``, ``started_at`` and ``finished_at``; may span many rows."""
    seconds = F.floor(
        (
            F.unix_micros(F.max("finished_at").cast("timestamp"))
            - F.unix_micros(F.min("started_at").cast("timestamp"))
        )
        / 1_000_000
    )
    return (
        runs.groupBy(key)
        .agg(F.sum("bytes").alias("bytes"), seconds.alias("seconds"))
        .withColumn("mb_s", mb_per_second(F.col("bytes"), F.col("seconds")))
    )


def throughput_verdict(
    rates: DataFrame, pass_at: float = PASS_MB_S, warn_at: float = WARN_MB_S
) -> DataFrame:
    """PASS/WARN/FAIL on the two-place rate; UNKNOWN where there is no rate."""
    return rates.withColumn("verdict", throughput_verdict_col(F.col("mb_s"), pass_at, warn_at))


def dedup_stats(summaries: DataFrame, key: str = "run_id") -> DataFrame:
    """Processed, added and stored bytes per run, and stored/processed to three places."""
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).cast("bigint")
    return (
        summaries.groupBy(key)
        .agg(
            total("total_bytes_processed").alias("processed"),
            total("data_added").alias("added"),
            total("data_added_packed").alias("packed"),
        )
        .withColumn(
            "ratio",
            F.when(F.col("processed") > 0, printed(F.col("packed") / F.col("processed"), 3)),
        )
    )


def integrity_verdict(checks: DataFrame, errors: DataFrame, key: str = "run_id") -> DataFrame:
    """Verification verdict per run.

    ``checks`` has one ``exit_code`` per run, ``errors`` the last summary error
    count (``value``) where one was logged. A missing count means none only when
    the exit code is 0; PASS needs both to be clean.
    """
    joined = checks.select(key, "exit_code").join(
        errors.select(key, F.col("value").try_cast("bigint").alias("_errors")), key, "left"
    )
    count = F.coalesce(F.col("_errors"), F.when(F.col("exit_code") == 0, F.lit(0).cast("bigint")))
    clean = (F.col("exit_code") == 0) & F.coalesce(count == 0, F.lit(False))
    return joined.select(
        key,
        "exit_code",
        count.alias("errors"),
        F.when(clean, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("verdict"),
    )


def resume_cost(
    runs: DataFrame,
    pair: str = "pair_id",
    pass_pct: float = PASS_REUPLOAD_PCT,
    warn_pct: float = WARN_REUPLOAD_PCT,
) -> DataFrame:
    """Re-upload share of a resumed run against the run it resumes.

    ``runs`` has ``role`` (``interrupted`` or ``resume``), ``data_added`` (last
    summary) and ``bytes_done`` (last status). An interrupted run often has no
    summary, so its status figure stands in.
    """
    interrupted = F.col("role") == "interrupted"
    return (
        runs.groupBy(pair)
        .agg(
            F.max(F.when(interrupted, F.coalesce("data_added", "bytes_done"))).alias("first_bytes"),
            F.coalesce(F.max(F.when(F.col("role") == "resume", F.col("data_added"))), F.lit(0))
            .cast("bigint")
            .alias("resume_bytes"),
        )
        .withColumn(
            "reupload_pct",
            F.when(
                F.col("first_bytes") > 0,
                printed(F.col("resume_bytes") / F.col("first_bytes") * 100, 1),
            ),
        )
        .withColumn(
            "verdict",
            F.when(F.col("reupload_pct").isNull(), F.lit("WARN"))
            .when(F.col("reupload_pct") < pass_pct, F.lit("PASS"))
            .when(F.col("reupload_pct") < warn_pct, F.lit("WARN"))
            .otherwise(F.lit("FAIL")),
        )
    )


def run_summary(reports: DataFrame, dims: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """Runs, success share, duration percentiles and failures, with rolled-up subtotals.

    ``level`` is Spark's ``grouping_id``: 0 for the finest rows, all ones for the
    grand total. Percentiles are sketches of bounded size.
    """
    runs = F.count(F.lit(1))
    return reports.rollup(*dims).agg(
        F.grouping_id().cast("bigint").alias("level"),
        runs.alias("runs"),
        F.round(F.count_if(F.col("status") == "success") / runs, 4).alias("success_share"),
        F.percentile_approx("duration_ms", 0.5, accuracy).alias("duration_p50_ms"),
        F.percentile_approx("duration_ms", 0.95, accuracy).alias("duration_p95_ms"),
        F.sum("failed_files").cast("bigint").alias("failed_files"),
    )


def run_sketches(reports: DataFrame, by: Sequence[str], k: int = 800) -> DataFrame:
    """``by, runs, succeeded, failed_files, durations``: what a summary of any coarser groups needs.

    ``durations`` is a quantile sketch of bounded size, built map-side; stored per day, it
    spares later summaries the reports.
    """
    return reports.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.sum("failed_files").cast("bigint").alias("failed_files"),
        F.kll_sketch_agg_bigint(F.col("duration_ms").cast("bigint"), F.lit(k)).alias("durations"),
    )


def summary_of(
    sketches: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]] | None = None
) -> DataFrame:
    """``run_summary`` from stored ``run_sketches``, over every subset of ``dims`` or the given ``sets``.

    ``level`` is ``grouping_id``. The quantile sketches are merged upwards, so the
    percentiles are within the sketch's rank error at every level; null without a duration.
    """
    runs, durations = F.sum("runs"), F.kll_merge_agg_bigint("durations")
    grouped = sketches.cube(*dims) if sets is None else sketches.groupingSets([[F.col(c) for c in x] for x in sets], *dims)
    merged = grouped.agg(
        F.grouping_id().cast("bigint").alias("level"),
        runs.alias("runs"),
        F.round(F.sum("succeeded") / runs, 4).alias("success_share"),
        F.sum("failed_files").cast("bigint").alias("failed_files"),
        durations.alias("_durations"),
    )
    known = F.kll_sketch_get_n_bigint("_durations") > 0
    at = lambda q: F.when(known, F.kll_sketch_get_quantile_bigint("_durations", F.lit(q)))
    return merged.withColumns({"duration_p50_ms": at(0.5), "duration_p95_ms": at(0.95)}).drop("_durations")


def wide_counts_total(reports: DataFrame, counters: Sequence[str] = RUN_COUNTERS) -> DataFrame:
    """Fleet total of each run counter, one row per counter.

    Summed while wide and turned long afterwards: one row is unpivoted, not the table.
    """
    sums = reports.agg(*[F.sum(c).cast("bigint").alias(c) for c in counters])
    return sums.unpivot([], list(counters), "counter", "total")


def verdict_gate(ledger: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Verdict counts; the gate passes when nothing failed."""
    counts = {
        name: F.count_if(F.col("verdict") == verdict)
        for name, verdict in (("passed", "PASS"), ("failed", "FAIL"), ("warned", "WARN"))
    }
    grouped = ledger.groupBy(*keys) if keys else ledger
    return grouped.agg(*[c.alias(n) for n, c in counts.items()]).withColumn(
        "gate", F.when(F.col("failed") == 0, F.lit("PASS")).otherwise(F.lit("FAIL"))
    )


def baseline_asof(runs: DataFrame, chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Each run with the last successful earlier run of the same source.

    Runs are ordered by start time and id. Adds ``baseline_run_id``,
    ``baseline_at``, ``baseline_files`` and ``baseline_bytes``.
    """
    success = F.struct("started_at", "run_id", "files", "bytes")
    rows = runs.withColumns(
        {
            "_chunk": time_chunk(F.col("started_at"), chunk),
            "_good": F.when(F.col("status") == "success", success),
        }
    )
    seeds = carry_seeds(
        rows, ["source"], "_chunk", {"_good": F.max("_good")}, {"_good": F.max}
    )
    both = rows.withColumn("_seed", F.lit(1)).unionByName(
        seeds.withColumn("_seed", F.lit(0)), allowMissingColumns=True
    )
    before = (
        Window.partitionBy("source", "_chunk")
        .orderBy("_seed", "started_at", "run_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        both.withColumn("_base", F.last("_good", ignorenulls=True).over(before))
        .filter("_seed = 1")
        .select(
            *runs.columns,
            F.col("_base.run_id").alias("baseline_run_id"),
            F.col("_base.started_at").alias("baseline_at"),
            F.col("_base.files").alias("baseline_files"),
            F.col("_base.bytes").alias("baseline_bytes"),
        )
    )


def sanity_band(runs: DataFrame, bands: DataFrame, chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Reasons to abort a run: too few files, too few bytes, or shrunk too far.

    ``bands`` has one row per source: ``min_files``, ``min_bytes``,
    ``max_shrink_pct``. Shrink is measured against the last success and trips on
    bytes or files. Without a baseline, or with an empty one, only the minimums count.
    """

    def shrunk(now: str, before: str) -> Column:
        fall = (F.col(before) - F.col(now)) * 100.0 / F.col(before)
        return F.when(F.col(before) > 0, fall > F.col("max_shrink_pct"))

    based = baseline_asof(runs, chunk)
    joined = salted_join(based, bands, ["source"], "left", ["run_id"])
    reasons = F.array_compact(
        F.array(
            F.when(F.col("files") < F.col("min_files"), F.lit("below_min_files")),
            F.when(F.col("bytes") < F.col("min_bytes"), F.lit("below_min_bytes")),
            F.when(shrunk("bytes", "baseline_bytes"), F.lit("bytes_shrunk")),
            F.when(shrunk("files", "baseline_files"), F.lit("files_shrunk")),
        )
    )
    return joined.select(
        "run_id", "source", reasons.alias("reasons"), (F.size(reasons) > 0).alias("abort")
    )


def overlapping_runs(
    runs: DataFrame, repo: str = "repo", chunk: str = DEFAULT_CHUNK
) -> DataFrame:
    """Runs that started while an earlier run on the same repository was still going."""
    rows = runs.select(repo, "run_id", "started_at", "finished_at").withColumns(
        {
            "_chunk": time_chunk(F.col("started_at"), chunk),
            "_end": F.struct("finished_at", "run_id"),
        }
    )
    seeds = carry_seeds(rows, [repo], "_chunk", {"_end": F.max("_end")}, {"_end": F.max})
    both = rows.withColumn("_seed", F.lit(1)).unionByName(
        seeds.withColumn("_seed", F.lit(0)), allowMissingColumns=True
    )
    before = (
        Window.partitionBy(repo, "_chunk")
        .orderBy("_seed", "started_at", "run_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        both.withColumn("_busy", F.max("_end").over(before))
        .filter((F.col("_seed") == 1) & (F.col("_busy.finished_at") > F.col("started_at")))
        .select(
            repo,
            "run_id",
            "started_at",
            F.col("_busy.run_id").alias("blocking_run_id"),
            F.col("_busy.finished_at").alias("busy_until"),
        )
    )


def staleness(
    runs: DataFrame, now: Column, max_age_hours: float, source: str = "source"
) -> DataFrame:
    """Hours since the last success of each source; ``current``, ``stale`` or ``never``."""
    last = F.max(F.when(F.col("status") == "success", F.col("finished_at")))
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(
        F.col("last_success").cast("timestamp")
    )
    hours = F.floor(micros / 3_600_000_000).cast("bigint")
    return (
        runs.groupBy(source)
        .agg(last.alias("last_success"))
        .select(
            source,
            "last_success",
            hours.alias("hours"),
            F.when(F.col("last_success").isNull(), F.lit("never"))
            .when(micros > F.lit(max_age_hours * 3_600_000_000), F.lit("stale"))
            .otherwise(F.lit("current"))
            .alias("state"),
        )
    )


def quota_trend(
    quota: DataFrame, mark: float = QUOTA_MARK, repo: str = "repo", chunk: str = DEFAULT_CHUNK
) -> DataFrame:
    """Change since the previous reading, and days until ``mark`` of the total is used.

    The runway follows the repository's fitted growth per day; it is 0 past the
    mark and null while usage does not grow.
    """
    days = F.unix_micros(F.col("taken_at").cast("timestamp")) / F.lit(SECONDS_PER_DAY * 1e6)
    rows = quota.withColumns(
        {
            "_chunk": time_chunk(F.col("taken_at"), chunk),
            "_x": days - F.lit(18_262.0),  # days since 2020: keeps the sums small
            "_key": F.struct("taken_at", "used"),
        }
    )
    known = F.col("used").isNotNull()
    used = F.col("used").cast("double")
    seen = F.when(known, F.col("_x"))
    per_chunk = rows.groupBy(repo, "_chunk").agg(
        F.max("_key").alias("_key"),
        F.count("used").alias("_n"),
        F.sum(seen).alias("_sx"),
        F.sum(used).alias("_sy"),
        F.sum(seen * used).alias("_sxy"),
        F.sum(seen * seen).alias("_sxx"),
    )
    whole = Window.partitionBy(repo)
    earlier = whole.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    n, sx, sy, sxy, sxx = (F.sum(c).over(whole) for c in ("_n", "_sx", "_sy", "_sxy", "_sxx"))
    spread = n * sxx - sx * sx
    seeds = per_chunk.select(
        repo,
        "_chunk",
        F.max("_key").over(earlier).alias("_key"),
        F.when(spread > 0, (n * sxy - sx * sy) / spread).alias("_slope"),
    )
    both = rows.withColumn("_seed", F.lit(1)).unionByName(
        seeds.withColumn("_seed", F.lit(0)), allowMissingColumns=True
    )
    order = Window.partitionBy(repo, "_chunk").orderBy("_seed", "taken_at", "used")
    slope = F.first("_slope").over(order.rowsBetween(Window.unboundedPreceding, 0))
    room = F.col("total") * F.lit(mark) - F.col("used")
    return (
        both.withColumns({"_prev": F.lag("_key").over(order), "_growth": slope})
        .filter("_seed = 1")
        .select(
            *quota.columns,
            (F.col("used") - F.col("_prev.used")).alias("delta"),
            F.when(F.col("used").isNull(), F.lit(None).cast("double"))
            .when(room <= 0, F.lit(0.0))
            .when(F.col("_growth") > 0, F.round(room / F.col("_growth"), 1))
            .alias("runway_days"),
        )
    )


def quota_reclaim(readings: DataFrame, prune: str = "prune_id") -> DataFrame:
    """Bytes a prune freed, from the readings labelled ``before`` and ``after``."""
    at = lambda label: F.max(F.when(F.col("label") == label, F.col("used")))
    return (
        readings.groupBy(prune)
        .agg(at("before").alias("used_before"), at("after").alias("used_after"))
        .withColumn("freed", F.col("used_before") - F.col("used_after"))
        .withColumn(
            "outcome",
            F.when(F.col("freed").isNull(), F.lit("unknown"))
            .when(F.col("freed") > 0, F.lit("reclaimed"))
            .otherwise(F.lit("not_reclaimed")),
        )
    )


def group_errors(failures: DataFrame, n: int = 3) -> DataFrame:
    """Identical errors together: how many, the first ``n`` paths, how many more.

    ``failures`` is one (``error``, ``path``) row per failure. Only the first
    ``n`` paths per error and map task are shuffled for the sample.
    """
    order = Window.partitionBy("error").orderBy("path")
    sample = (
        failures.select("error", "path")
        .withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") <= n)
        .groupBy("error")
        .agg(F.array_sort(F.collect_list("path")).alias("sample"))
    )
    counts = failures.groupBy("error").agg(F.count(F.lit(1)).alias("failures"))
    return counts.join(sample, "error", "left").withColumn(
        "more", F.greatest(F.col("failures") - n, F.lit(0).cast("bigint"))
    )


def progress_eta(
    events: DataFrame, n: int = 5, key: str = "run_id", chunk: str = DEFAULT_CHUNK,
    block_rows: int = 100_000,
) -> DataFrame:
    """Rate over the last ``n`` steps of each run's progress, and seconds left at that rate.

    ``events``: run, ``event_id``, ``ts``, ``bytes_done``, ``total_bytes``. A frame of
    ``n`` rows cannot be cut at a time chunk, so rows are first numbered within
    their run and then grouped in blocks of ``block_rows``; each block also gets
    the ``n`` rows before it. No group exceeds ``block_rows + n`` rows.
    """
    rows = events.withColumn("_chunk", time_chunk(F.col("ts"), chunk))
    seeds = carry_seeds(
        rows, [key], "_chunk", {"_before": F.count(F.lit(1))}, {"_before": F.sum}
    )
    both = rows.withColumn("_seed", F.lit(1)).unionByName(
        seeds.withColumn("_seed", F.lit(0)), allowMissingColumns=True
    )
    order = Window.partitionBy(key, "_chunk").orderBy("_seed", "ts", "event_id")
    before = F.coalesce(F.first("_before").over(order), F.lit(0))
    numbered = (
        both.withColumn("_rn", before + F.row_number().over(order) - 2)
        .filter("_seed = 1")
        .drop("_seed", "_before", "_chunk")
    )
    size = F.lit(block_rows)
    home = F.floor(F.col("_rn") / size)
    tail = F.floor((F.col("_rn") + n) / size)
    blocks = numbered.withColumn("_block", F.explode(F.sequence(home, tail))).withColumn(
        "_home", home
    )
    frame = Window.partitionBy(key, "_block").orderBy("_rn").rowsBetween(-n, 0)
    first = F.first(F.struct("ts", "bytes_done")).over(frame)
    moved = (F.col("bytes_done") - F.col("_first.bytes_done")).cast("double")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(
        F.col("_first.ts").cast("timestamp")
    )
    return (
        blocks.withColumn("_first", first)
        .filter(F.col("_block") == F.col("_home"))
        .withColumn("rate", F.when(micros > 0, moved * 1e6 / micros))
        .withColumn(
            "eta_s",
            F.when(
                F.col("rate") > 0,
                F.ceil((F.col("total_bytes") - F.col("bytes_done")) / F.col("rate")),
            ).cast("bigint"),
        )
        .select(*events.columns, F.round("rate", 2).alias("rate"), "eta_s")
    )


def rank_sources(
    runs: DataFrame, metric: str = "bytes", source: str = "source", tiles: int = 10
) -> DataFrame:
    """Sources by total of ``metric``, largest first: rank, percent rank, tile, share of all, running total.

    Equal totals share a rank and a running total (all of them included); tiles go by
    total, then source. A null metric counts as nothing; a source with no other is last.
    """
    totals = runs.groupBy(source).agg(F.sum(metric).cast("bigint").alias("total"))
    order = [F.desc_nulls_last("total"), F.asc_nulls_first(source)]
    placed = with_places(totals, order, ["total"])
    equal = placed.groupBy("total").agg(
        F.min("_place").alias("rank"), F.max("_upto_total").alias("running"), F.max("_rows").alias("_all_rows")
    )
    same = F.col("p.total").eqNullSafe(F.col("e.total"))
    return placed.alias("p").join(equal.alias("e"), same).select(
        source,
        "p.total",
        F.col("rank").cast("bigint").alias("rank"),
        F.when(F.col("_all_rows") > 1, (F.col("rank") - 1) / (F.col("_all_rows") - 1)).otherwise(F.lit(0.0)).alias("percent_rank"),
        ntile_of(F.col("_place"), F.col("_rows"), tiles).alias("tile"),
        F.round(F.col("p.total") / F.col("_all_total"), 6).alias("share"),
        F.col("running").cast("bigint").alias("running"),
    )


def top_failing(reports: DataFrame, k: int, source: str = "source") -> DataFrame:
    """The ``k`` sources with the most failed files, ties by source."""
    return (
        reports.groupBy(source)
        .agg(F.sum("failed_files").cast("bigint").alias("failed_files"))
        .orderBy(F.desc("failed_files"), source)
        .limit(k)
    )


def project_seed(totals: DataFrame, rates: DataFrame) -> DataFrame:
    """Days to move each source's bytes at its latest measured rate.

    ``totals``: ``source``, ``bytes``. ``rates``: ``source``, ``measured_at``,
    ``mb_s``; the newest non-null rate counts.
    """
    latest = (
        rates.filter(F.col("mb_s").isNotNull())
        .groupBy("source")
        .agg(F.max(F.struct("measured_at", "mb_s")).alias("_latest"))
        .select("source", F.col("_latest.mb_s").alias("mb_s"))
    )
    return totals.select("source", "bytes").join(latest, "source", "left").select(
        "source", "bytes", "mb_s", seed_days(F.col("bytes"), F.col("mb_s")).alias("days")
    )


def pack_plan(
    totals: DataFrame,
    pack_mib: Sequence[int] = (16, 64, 128),
    s_per_object: float = 30.0,
    connections: int = 4,
    mb_s: float = 5.0,
) -> DataFrame:
    """Per total and pack size: objects, metadata and transfer days, which one limits, temp bytes."""
    sizes = F.array(*[F.lit(m) for m in pack_mib])
    pack = F.col("pack_mib").cast("bigint") * BYTES_PER_MIB
    objects = F.ceil(F.col("bytes") / pack)
    metadata = objects * F.lit(s_per_object) / F.lit(connections)
    transfer = F.col("bytes") / F.lit(mb_s * BYTES_PER_MB)
    return totals.withColumn("pack_mib", F.explode(sizes)).select(
        *totals.columns,
        "pack_mib",
        objects.alias("objects"),
        printed(metadata / SECONDS_PER_DAY, 1).alias("metadata_days"),
        printed(transfer / SECONDS_PER_DAY, 1).alias("transfer_days"),
        F.when(metadata > transfer, F.lit("metadata"))
        .otherwise(F.lit("bandwidth"))
        .alias("bottleneck"),
        (pack * F.lit(connections + 1)).alias("temp_bytes"),
    )
