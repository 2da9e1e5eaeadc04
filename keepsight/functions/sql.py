"""The column functions as SQL functions: plain expressions, no Python per row."""

from __future__ import annotations

from pyspark.sql import SparkSession

from keepsight.functions.chars import SPACE_CLASS
from keepsight.functions.classify import EXIT_CODE_BY_FAILURE, failure_rules
from keepsight.functions.redaction import ASSIGNMENT, EMAIL, ENVIRONMENT, MARKER
from keepsight.functions.units import DURATION_UNITS_MS, SIZE_UNITS

_QUANTITY = rf"\A([0-9]+(?:\.[0-9]+)?){SPACE_CLASS}*([a-zA-Z]*)\z"


def _raw(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _map(table: dict) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else f"CAST({v} AS BIGINT)"

    return "map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in table.items()) + ")"


def _quantity(units: dict[str, int], unit: str, half: str) -> str:
    text = f"regexp_replace(s, {_raw(rf'\A{SPACE_CLASS}+|{SPACE_CLASS}+\z')}, '')"
    amount = f"TRY_CAST(regexp_extract({text}, {_raw(_QUANTITY)}, 1) AS DOUBLE)"
    suffix = f"lower(regexp_extract({text}, {_raw(_QUANTITY)}, 2))"
    value = f"{amount} * try_element_at({_map(units)}, {unit.format(suffix=suffix)}){half}"
    return (
        f"CASE WHEN {text} RLIKE {_raw(_QUANTITY)} AND {value} < 9223372036854775808D "
        f"THEN CAST(floor({value}) AS BIGINT) END"
    )


def register_functions(spark: SparkSession, provider: str = "") -> None:
    """Create temporary functions ``size_bytes``, ``duration_ms``, ``failure_code``,
    ``failure_exit`` and ``redact_text``.

    Text that is not a valid size or duration gives NULL.
    """
    # "kb" and the like look up nothing, so they are refused like any unknown unit
    size_unit = (
        "CASE WHEN {suffix} = '' THEN 'b' ELSE regexp_replace({suffix}, r'ib\\z', '') END"
    )
    rules = " ".join(
        "WHEN "
        + " OR ".join(f"contains(lower(s), '{p}')" for p in phrases)
        + f" THEN '{code}'"
        for code, phrases in failure_rules(provider)
    )
    redacted = "s"
    for pattern, replacement in (
        (ASSIGNMENT, f"$1 = {MARKER}"),
        (ENVIRONMENT, f"$1={MARKER}"),
        (EMAIL, MARKER),
    ):
        redacted = f"regexp_replace({redacted}, {_raw(pattern)}, '{replacement}')"
    bodies = {
        "size_bytes(s STRING) RETURNS BIGINT": _quantity(SIZE_UNITS, size_unit, ""),
        "duration_ms(s STRING) RETURNS BIGINT": _quantity(
            DURATION_UNITS_MS, "{suffix}", " + 0.5D"
        ),
        "failure_code(s STRING) RETURNS STRING": (
            f"CASE WHEN s IS NULL THEN 'none' {rules} ELSE 'unknown' END"
        ),
        "failure_exit(s STRING) RETURNS INT": (
            f"CAST(try_element_at({_map(EXIT_CODE_BY_FAILURE)}, s) AS INT)"
        ),
        "redact_text(s STRING) RETURNS STRING": redacted,
    }
    for signature, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
