"""Size, duration and bandwidth-timetable text as column expressions.

Sizes are 1024-based; rates elsewhere are decimal MB/s. Anything ambiguous is
rejected with a reason code, never guessed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepsight.functions.chars import SPACE_CLASS, let, strip

# Unit letters and what they multiply by.
SIZE_UNITS = {
    "b": 1,
    "k": 1024,
    "m": 1024**2,
    "g": 1024**3,
    "t": 1024**4,
    "p": 1024**5,
}
DURATION_UNITS_MS = {"s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
AMBIGUOUS_SIZE_SUFFIX = r"\A[kmgtp]b\z"
HHMM = r"\A(?:[01][0-9]|2[0-3]):[0-5][0-9]\z"
RATE = r"\A[0-9]+(?:\.[0-9]+)?[a-zA-Z]*\z"
RATE_OFF = "off"

_NUMBER = r"[0-9]+(?:\.[0-9]+)?"
_QUANTITY = rf"\A({_NUMBER}){SPACE_CLASS}*([a-zA-Z]*)\z"
_BARE_NUMBER = rf"\A{_NUMBER}\z"
_BIGINT_LIMIT = float(2**63)


def _unit_map(units: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in units.items() for x in pair])


def _checked(amount: Column, reason: Column) -> Column:
    """``struct<value bigint, reason string>``; an amount past bigint is a reason too."""
    too_big = reason.isNull() & (amount >= F.lit(_BIGINT_LIMIT))
    reason = F.when(too_big, F.lit("out_of_range")).otherwise(reason)
    value = F.when(reason.isNull(), F.floor(amount).cast("bigint"))
    return F.struct(value.alias("value"), reason.alias("reason"))


def parse_size(text: Column) -> Column:
    """``"10G"`` -> ``struct<value=10737418240, reason=null>``.

    Reasons: ``empty``, ``malformed``, ``ambiguous_decimal``, ``unknown_suffix``,
    ``out_of_range``.
    """

    def of(raw: Column) -> Column:
        amount = F.regexp_extract(raw, _QUANTITY, 1).try_cast("double")
        suffix = F.lower(F.regexp_extract(raw, _QUANTITY, 2))
        unit = F.when(suffix == "", F.lit("b")).otherwise(
            F.regexp_replace(suffix, r"ib\z", "")
        )
        factor = F.try_element_at(_unit_map(SIZE_UNITS), unit)
        reason = (
            F.when(raw == "", F.lit("empty"))
            .when(~raw.rlike(_QUANTITY), F.lit("malformed"))
            .when(suffix.rlike(AMBIGUOUS_SIZE_SUFFIX), F.lit("ambiguous_decimal"))
            .when(factor.isNull(), F.lit("unknown_suffix"))
        )
        return _checked(amount * factor, reason)

    return let(F.coalesce(strip(text), F.lit("")), of)


def size_from_number(number: Column) -> Column:
    """Byte count given as a number: must be finite and not negative."""
    value = number.cast("double")
    reason = F.when(
        value.isNull() | F.isnan(value) | (value == float("inf")), F.lit("malformed")
    ).when(value < 0, F.lit("negative"))
    return _checked(value, reason)


def parse_duration(text: Column) -> Column:
    """``"1.5h"`` -> ``struct<value=5400000, reason=null>``; the unit is mandatory.

    Reasons: ``empty``, ``bare_number``, ``malformed``, ``unknown_unit``,
    ``out_of_range``.
    """

    def of(raw: Column) -> Column:
        amount = F.regexp_extract(raw, _QUANTITY, 1).try_cast("double")
        unit = F.lower(F.regexp_extract(raw, _QUANTITY, 2))
        factor = F.try_element_at(_unit_map(DURATION_UNITS_MS), unit)
        reason = (
            F.when(raw == "", F.lit("empty"))
            .when(raw.rlike(_BARE_NUMBER), F.lit("bare_number"))
            .when(~raw.rlike(_QUANTITY), F.lit("malformed"))
            .when(factor.isNull(), F.lit("unknown_unit"))
        )
        return _checked(amount * factor + F.lit(0.5), reason)

    return let(F.coalesce(strip(text), F.lit("")), of)


def _is_rate(token: Column) -> Column:
    return (F.lower(token) == RATE_OFF) | token.rlike(RATE)


def timetable_entries(text: Column) -> Column:
    """Bandwidth text -> ``array<struct<hhmm, rate, error>>``, one per entry.

    A value with no comma anywhere must be exactly one rate; once one entry has
    a comma, every entry must be ``HH:MM,rate``.
    """

    def plain(tokens: Column, token: Column) -> Column:
        bad = (F.size(tokens) != 1) | ~_is_rate(token)
        error = F.when(token == "", F.lit("empty")).when(bad, F.lit("bad_rate"))
        return F.struct(
            F.lit(None).cast("string").alias("hhmm"),
            token.alias("rate"),
            error.alias("error"),
        )

    def entry(token: Column) -> Column:
        fields = F.split(token, ",", -1)
        hhmm, rate = F.get(fields, F.lit(0)), F.get(fields, F.lit(1))
        error = (
            F.when(F.size(fields) != 2, F.lit("bad_entry"))
            .when(~hhmm.rlike(HHMM), F.lit("bad_time"))
            .when(~_is_rate(rate), F.lit("bad_rate"))
        )
        return F.struct(hhmm.alias("hhmm"), rate.alias("rate"), error.alias("error"))

    def of(tokens: Column) -> Column:
        timed = F.exists(tokens, lambda token: token.contains(","))
        return F.when(timed, F.transform(tokens, entry)).otherwise(
            F.transform(tokens, lambda token: plain(tokens, token))
        )

    # a stripped text has an empty token only when it is empty altogether
    return let(F.split(F.coalesce(strip(text), F.lit("")), f"{SPACE_CLASS}+"), of)


def timetable_error(text: Column) -> Column:
    """First error code of a timetable, or null when it is valid."""
    errors = F.filter(
        F.transform(timetable_entries(text), lambda e: e["error"]), lambda e: e.isNotNull()
    )
    return F.get(errors, F.lit(0))
