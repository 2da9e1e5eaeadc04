"""Five-field cron text as column expressions.

Subset: ``*``, lists, ranges and ``/step``; Sunday is 0 or 7; names are not read.
An expression that restricts both day-of-month and day-of-week is refused,
because tools disagree on whether that means AND or OR.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lowest and highest value of each cron field.
FIELD_BOUNDS = {
    "minute": (0, 59),
    "hour": (0, 23),
    "day": (1, 31),
    "month": (1, 12),
    "weekday": (0, 7),
}

_ITEM = r"\A(\*|([0-9]{1,2})(?:-([0-9]{1,2}))?)(?:/([0-9]{1,2}))?\z"


def cron_fields(expression: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(expression, r"\s+", " ")), " ")


def _item_values(item: Column, low: Column, high: Column) -> Column:
    """Values of one list item, or null when it is not valid."""
    first = F.regexp_extract(item, _ITEM, 2).try_cast("int")
    last = F.regexp_extract(item, _ITEM, 3).try_cast("int")
    step = F.regexp_extract(item, _ITEM, 4).try_cast("int")
    start = F.coalesce(first, low)
    # a lone number stands for itself, or with a step runs to the end of the field
    stop = F.coalesce(last, F.when(first.isNull() | step.isNotNull(), high), first)
    valid = (
        item.rlike(_ITEM)
        & (start >= low)
        & (stop <= high)
        & (start <= stop)
        & (F.coalesce(step, F.lit(1)) >= 1)
    )
    return F.when(valid, F.sequence(start, stop, F.coalesce(step, F.lit(1))))


def cron_values(expression: Column) -> Column:
    """``array<array<int>>``: the values each field allows, in the order of ``FIELD_BOUNDS``.

    A field that is not valid is null. Sunday is always 0.
    """
    lows = F.array(*[F.lit(low) for low, _ in FIELD_BOUNDS.values()])
    highs = F.array(*[F.lit(high) for _, high in FIELD_BOUNDS.values()])

    def one(field: Column, i: Column) -> Column:
        items = F.transform(
            F.split(field, ","), lambda item: _item_values(item, F.get(lows, i), F.get(highs, i))
        )
        # flatten gives null when any item is null
        values = F.flatten(items)
        return F.array_distinct(
            F.transform(values, lambda v: F.when((i == 4) & (v == 7), F.lit(0)).otherwise(v))
        )

    return F.transform(F.slice(cron_fields(expression), 1, 5), one)


def cron_error(expression: Column, values: Column | None = None) -> Column:
    """Reason an expression is refused, or null; ``values`` if already worked out."""
    fields = cron_fields(expression)
    values = cron_values(expression) if values is None else values
    names = F.array(*[F.lit(f"bad_{name}") for name in FIELD_BOUNDS])
    bad = F.array_compact(
        F.transform(values, lambda v, i: F.when(v.isNull(), F.get(names, i)))
    )
    both = ~F.get(fields, F.lit(2)).startswith("*") & ~F.get(fields, F.lit(4)).startswith("*")
    return (
        F.when(expression.isNull() | (F.size(fields) != 5), F.lit("field_count"))
        .when(F.size(bad) > 0, F.get(bad, F.lit(0)))
        .when(both, F.lit("day_and_weekday"))
    )
