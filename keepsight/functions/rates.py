"""Rates, projections and verdicts. Verdicts compare the rounded figure that is shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verdict thresholds and unit sizes.
PASS_MB_S = 3.0
WARN_MB_S = 2.0
PASS_REUPLOAD_PCT = 25.0
WARN_REUPLOAD_PCT = 50.0
BYTES_PER_MB = 1_000_000
BYTES_PER_MIB = 1024**2
SECONDS_PER_DAY = 86_400


_SPLIT = float(2**27 + 1)


def printed(value: Column, places: int) -> Column:
    """A figure as C prints it with that many places: rounded on its exact value.

    ``round`` works on a double's shortest decimal text and takes 0.575 to 0.58;
    the double lies below that tie, and prints as 0.57. Here the scaled value and
    its rounding error are both kept, so ties are judged exactly; a true tie goes
    to the even digit. For magnitudes up to about 1e15.
    """
    scale = float(10**places)
    magnitude = F.abs(value)
    scaled = magnitude * F.lit(scale)
    shifted = magnitude * F.lit(_SPLIT)
    high = shifted - (shifted - magnitude)
    error = (high * F.lit(scale) - scaled) + (magnitude - high) * F.lit(scale)
    whole = F.floor(scaled).cast("double")
    over = scaled - whole - F.lit(0.5)
    up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    return F.signum(value) * (whole + F.when(up, 1.0).otherwise(0.0)) / F.lit(scale)


def mb_per_second(num_bytes: Column, seconds: Column) -> Column:
    """Decimal MB/s to two places; null when no whole second has passed."""
    return F.when(
        seconds > 0, printed(num_bytes.cast("double") / seconds / F.lit(BYTES_PER_MB), 2)
    )


def throughput_verdict_col(
    mb_s: Column, pass_at: float = PASS_MB_S, warn_at: float = WARN_MB_S
) -> Column:
    return (
        F.when(mb_s.isNull(), F.lit("UNKNOWN"))
        .when(mb_s >= pass_at, F.lit("PASS"))
        .when(mb_s >= warn_at, F.lit("WARN"))
        .otherwise(F.lit("FAIL"))
    )


def seed_days(num_bytes: Column, mb_s: Column) -> Column:
    """Days to move ``num_bytes`` at ``mb_s``, one place; null for a rate of zero."""
    return F.when(
        mb_s > 0,
        printed(
            num_bytes.cast("double") / (mb_s * F.lit(BYTES_PER_MB)) / F.lit(SECONDS_PER_DAY), 1
        ),
    )
