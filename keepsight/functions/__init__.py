"""Pure column functions: no actions, no Python on the row path."""

from keepsight.functions.classify import (
    classify_engine_exit_col,
    classify_failure,
    classify_transport,
    exit_code_of,
)
from keepsight.functions.globs import glob_to_regex, matches_any
from keepsight.functions.redaction import redact_known, redact_shapes
from keepsight.functions.rates import mb_per_second, seed_days, throughput_verdict_col
from keepsight.functions.shards import shard_of
from keepsight.functions.units import (
    parse_duration,
    parse_size,
    size_from_number,
    timetable_entries,
    timetable_error,
)

__all__ = [
    "classify_engine_exit_col",
    "classify_failure",
    "classify_transport",
    "exit_code_of",
    "glob_to_regex",
    "matches_any",
    "mb_per_second",
    "parse_duration",
    "parse_size",
    "redact_known",
    "redact_shapes",
    "seed_days",
    "shard_of",
    "size_from_number",
    "throughput_verdict_col",
    "timetable_entries",
    "timetable_error",
]
