"""Column functions against the asserted values of the fixtures."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from keepsight.functions import (
    classify_failure,
    classify_transport,
    exit_code_of,
    glob_to_regex,
    mb_per_second,
    parse_duration,
    parse_size,
    redact_known,
    redact_shapes,
    seed_days,
    size_from_number,
    throughput_verdict_col,
    timetable_error,
)
from keepsight.functions.chars import let
from keepsight.functions.classify import EXIT_CODE_BY_FAILURE, failure_rules
from keepsight.functions.cron import cron_error, cron_values
from keepsight.functions.rates import printed
from keepsight.functions.redaction import usable_secrets
from keepsight.functions.sql import register_functions


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i long, x {kind}")
    rows = df.select("i", fn(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]


SIZES = {
    "1024": 1024, "1K": 1024, "10G": 10737418240, "10g": 10737418240, "  10 G  ": 10737418240,
    "2T": 2199023255552, "1P": 1125899906842624, "1KiB": 1024, "1GiB": 1073741824,
    "1.5G": 1610612736, "10BiB": 10, "\t7K\n": 7168, " 7K": 7168, "0": 0,
    "10GB": "ambiguous_decimal", "10MB": "ambiguous_decimal", "10kb": "ambiguous_decimal",
    "10X": "unknown_suffix", "10ib": "unknown_suffix", "1constructor": "unknown_suffix",
    "": "empty", "  ": "empty", "lots": "malformed", "1 2 G": "malformed", "-1": "malformed",
    "9000000P": "out_of_range",
}
DURATIONS = {
    "30s": 30_000, "5m": 300_000, "20h": 72_000_000, "7d": 604_800_000, "2H": 7_200_000,
    "1.5h": 5_400_000, "0.0005s": 1, "5": "bare_number", "5w": "unknown_unit", "": "empty",
    "soon": "malformed",
}


@pytest.mark.parametrize("parse,cases", [(parse_size, SIZES), (parse_duration, DURATIONS)])
def test_units(spark, parse, cases):
    got = apply(spark, list(cases), parse)
    assert [g["value"] if g["reason"] is None else g["reason"] for g in got] == list(cases.values())


def test_numeric_sizes(spark):
    values = [5.9, 0.0, -1.0, float("nan"), float("inf"), None]
    got = apply(spark, values, size_from_number, "double")
    assert [(g["value"], g["reason"]) for g in got] == [
        (5, None), (0, None), (None, "negative"), (None, "malformed"), (None, "malformed"),
        (None, "malformed"),
    ]


def test_timetables(spark):
    good = ["2M", "off", "OFF", "512k", "  2M  ", "00:00,off 08:00,2M 18:00,off", "00:00,off\t08:00,2M"]
    bad = {
        "24:00,2M": "bad_time", "8:00,2M": "bad_time", "00:60,2M": "bad_time", "08:00,fast": "bad_rate",
        "08:00,2M,extra": "bad_entry", "": "empty", "sometimes": "bad_rate", "2M 3M": "bad_rate",
        "08:00,2M off": "bad_entry",
    }
    assert apply(spark, good, timetable_error) == [None] * len(good)
    assert apply(spark, list(bad), timetable_error) == list(bad.values())


FAILURES = {
    "Backup failed: 2 uploads did not complete. Failed files: a": ("upload-failed", 13),
    "Restore verification failed: 1 files had checksum mismatches.": ("verify-failed", 15),
    "Delete sync failed: 1 remote deletions did not complete.": ("delete-sync-failed", 16),
    "Source directory is required": ("usage-error", 2),
    "ACME CLI not found": ("cli-missing", 10),
    "Not authenticated with acme": ("auth-missing", 11),
    "other CLI not found": ("unknown", 1),
    "request timed out after SIGTERM": ("timeout", 19),
    "boom": ("unknown", 1),
}


def test_failures(spark):
    codes = apply(spark, list(FAILURES), lambda c: classify_failure(c, failure_rules("Acme")))
    assert codes == [code for code, _ in FAILURES.values()]
    assert apply(spark, codes, exit_code_of) == [n for _, n in FAILURES.values()]
    assert len(EXIT_CODE_BY_FAILURE) == len(set(EXIT_CODE_BY_FAILURE.values())) == 15
    # with no provider named, its rules match whatever the name
    assert apply(spark, ["some CLI not found"], classify_failure) == ["cli-missing"]


def test_transport(spark):
    cases = {
        "x: mnemonic is required - please run: config reconnect ix:": "auth_expired",
        "failed to get token - empty token found": "auth_expired",
        "access not allowed for this user tier (status 402)": "tier_blocked",
        "status 402, failed to get token": "tier_blocked",
        "connection reset by peer": "other",
    }
    assert apply(spark, list(cases), classify_transport) == list(cases.values())


REDACTED = {
    "pass = river7stone": "pass = [redacted]",
    "PassWord=x y": "PassWord = [redacted] y",
    "set RCLONE_CONFIG_COLD_PASS=q9w8e7 and RCLONE_CONFIG_COLD_KIND=disk":
        "set RCLONE_CONFIG_COLD_PASS=[redacted] and RCLONE_CONFIG_COLD_KIND=disk",
    "RESTIC_PASSWORD=blue-heron-41": "RESTIC_PASSWORD=[redacted]",
    "send it to ops.team+1@host.example today": "send it to [redacted] today",
    "épass = x1": "épass = [redacted]",
    "my_pass = x1": "my_pass = x1",
    "token = ab cd": "token = [redacted] cd",
    "uploaded 10 files, 3 errors": "uploaded 10 files, 3 errors",
}


def test_shapes(spark):
    assert apply(spark, list(REDACTED), redact_shapes) == list(REDACTED.values())


def test_known_values(spark):
    odd = r"a.b*c+d?e^f$g{h}i(j)k|l[m]n\o"
    secrets = ["battery-staple", "correct-horse-battery-staple", "abc", "redacted", odd, None]
    texts = ["value: correct-horse-battery-staple", f"<{odd}>", "abc redacted", "battery-staple " * 2]
    assert apply(spark, texts, lambda c: redact_known(c, secrets)) == [
        "value: [redacted]", "<[redacted]>", "abc redacted", "[redacted] " * 2,
    ]
    assert usable_secrets(secrets)[0] == odd


GLOBS = [
    ("*.jpg", "a.jpg", True), ("*.jpg", "d/a.jpg", False), ("a.txt", "a.txt", True),
    ("*.{jpg,png}", "a.png", True), ("*.{jpg,png}", "a.gif", False), ("file?.txt", "file1.txt", True),
    ("file?.txt", "file12.txt", False), ("**/*.jpg", "a.jpg", True), ("**/*.jpg", "x/y/a.jpg", True),
    ("**/@eaDir/**", "x/@eaDir/y/z", True), ("[a-c]*", "bx", True), ("[!a-c]*", "bx", False),
    ("a.b", "axb", False), ("{a,b/{c,d}}", "b/d", True),
]


def test_globs(spark):
    for pattern, path, expected in GLOBS:
        regex = r"\A(?:" + glob_to_regex(pattern) + r")\z"
        assert apply(spark, [path], lambda c: c.rlike(regex)) == [expected], (pattern, path)  # noqa: B023


def test_rates(spark):
    rate = lambda b, s: spark.range(1).select(
        mb_per_second(F.lit(b), F.lit(s)).alias("r")
    ).first()["r"]
    assert [rate(1_000_000_000, 100), rate(500_000_000, 100), rate(1, 0), rate(1, -5)] == [10.0, 5.0, None, None]
    days = apply(spark, [5.0, 3.0, 2.0, 10.0, 0.0], lambda r: seed_days(F.lit(4 * 1024**4), r), "double")
    assert days == [10.2, 17.0, 25.5, 5.1, None]
    # the shown figure decides: 2.996 is shown as 3.00
    shown = apply(spark, [2.996, 2.994, 1.996, 1.99, None], lambda r: throughput_verdict_col(printed(r, 2)), "double")
    assert shown == ["PASS", "WARN", "WARN", "FAIL", "UNKNOWN"]


def test_printed_rounds_like_printf(spark):
    rng = random.Random(7)
    values = [rng.randint(0, 10**6) / 1000 for _ in range(3000)] + [0.575, 1.115, 2.675, 5e-5, 0.125, -0.575]
    for places in (1, 2, 3, 4):
        got = apply(spark, values, lambda c: printed(c, places), "double")  # noqa: B023
        assert got == [float(f"%.{places}f" % v) for v in values]


def test_cron(spark):
    errors = {
        "0 2 * * *": None, "0 4 1 */3 *": None, "*/15 1-3,5 * * 1-5": None, "not-a-cron": "field_count",
        "* *": "field_count", "99 99 99 99 99": "bad_minute", "0 0 1 * 1": "day_and_weekday",
        "0 24 * * *": "bad_hour", "0 5-3 * * *": "bad_hour", "0 */0 * * *": "bad_hour", None: "field_count",
    }
    assert apply(spark, list(errors), cron_error) == list(errors.values())
    values = apply(spark, ["5/20 */6 1,15 */3 7"], cron_values)[0]
    assert values == [[5, 25, 45], [0, 6, 12, 18], [1, 15], [1, 4, 7, 10], [0]]


def test_sql_functions_agree(spark):
    register_functions(spark, "acme")
    texts = [*SIZES, *DURATIONS, *FAILURES, *REDACTED]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    got = df.select(
        "x",
        F.expr("size_bytes(x)").eqNullSafe(parse_size(F.col("x"))["value"]).alias("size"),
        F.expr("duration_ms(x)").eqNullSafe(parse_duration(F.col("x"))["value"]).alias("duration"),
        F.expr("failure_code(x)").eqNullSafe(classify_failure(F.col("x"), failure_rules("acme"))).alias("code"),
        F.expr("failure_exit(failure_code(x))").eqNullSafe(
            exit_code_of(classify_failure(F.col("x"), failure_rules("acme")))
        ).alias("exit"),
        F.expr("redact_text(x)").eqNullSafe(redact_shapes(F.col("x"))).alias("redacted"),
    )
    for row in got.collect():
        assert all(v for k, v in row.asDict().items() if k != "x"), row


def test_a_named_value_is_used_as_it_is_and_its_use_is_not_typed_in_every_row(spark):
    rows = spark.createDataFrame([(1, "a"), (None, None)], "n int, s string")
    nested = let(F.struct("n", "s"), lambda v: let(F.concat(v["s"], v["s"]), lambda w: F.array(w, v["n"].cast("string"), w)))
    out = rows.select(nested.alias("x"), let(F.col("n"), lambda n: n.isNull()).alias("y"))
    assert [tuple(r) for r in out.collect()] == [(["aa", "1", "aa"], False), ([None, None, None], True)]
    # an element taken from an array asks for the type of all that makes it, for each row
    assert "transform(" not in out._jdf.queryExecution().optimizedPlan().toString()
