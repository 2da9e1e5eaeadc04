"""Engine event logs: select, last usable value, transport errors, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsight.functions.classify import (
    AUTH_EXPIRED,
    classify_engine_exit_col,
    classify_failure,
    classify_transport,
    exit_code_of,
    failure_rules,
)


def event_select(events: DataFrame, message_type: str, field: str) -> DataFrame:
    """Events of one type with one field, as text; other columns of the row stay out.

    ``events``: ``run_id``, ``line_no``, ``event`` (variant).
    """
    return events.filter(_type_is(message_type)).select(
        "run_id", "line_no", _field(field).alias("value")
    )


def last_event_value(events: DataFrame, message_type: str, field: str) -> DataFrame:
    """Last usable value of a field per run: null and false do not count, the text "false" does."""
    value = _field(field)
    kind = F.schema_of_variant(F.try_variant_get("event", f"$.{field}", "variant"))
    # the type is only asked of values that read "false", so never of a nested one
    usable = value.isNotNull() & F.when(value == "false", kind != "BOOLEAN").otherwise(F.lit(True))
    return (
        events.filter(_type_is(message_type) & usable)
        .select("run_id", "line_no", value.alias("value"))
        .groupBy("run_id")
        .agg(F.max_by("value", "line_no").alias("value"))
    )


def _type_is(message_type: str) -> Column:
    return F.try_variant_get("event", "$.message_type", "string") == message_type


def _field(field: str) -> Column:
    return F.try_variant_get("event", f"$.{field}", "string")


def classify_failures(df: DataFrame, col: str, provider: str = "") -> DataFrame:
    """Adds ``failure_code`` and ``exit_code`` for a message column."""
    code = classify_failure(F.col(col), failure_rules(provider))
    return df.withColumn("failure_code", code).withColumn(
        "exit_code", exit_code_of(F.col("failure_code"))
    )


def classify_engine_exit(df: DataFrame, col: str) -> DataFrame:
    """Adds ``meaning`` for a column of engine exit codes."""
    return df.withColumn("meaning", classify_engine_exit_col(F.col(col)))


def classify_transport_errors(df: DataFrame, col: str) -> DataFrame:
    """Adds ``transport_class`` for a column of transport output."""
    return df.withColumn("transport_class", classify_transport(F.col(col)))


def first_auth_expiry(artefacts: DataFrame, text: str = "text") -> DataFrame:
    """First artefact of each run, by file name, that shows an expired session."""
    return (
        artefacts.filter(F.col(text).rlike(AUTH_EXPIRED))
        .groupBy("run_id")
        .agg(F.min("file").alias("file"))
    )


def token_expiry_audit(tokens: DataFrame, col: str, now: Column) -> DataFrame:
    """Expiry of each token's payload: ``expires_at``, whole ``hours_left``, ``expired``.

    Null where the payload cannot be read.
    """
    payload = F.translate(F.split_part(F.col(col), F.lit("."), F.lit(2)), "-_", "+/")
    valid = payload.rlike(r"\A[A-Za-z0-9+/]+={0,2}\z") & (
        F.length(F.regexp_replace(payload, "=", "")) % 4 != 1
    )
    decoded = F.when(valid, F.unbase64(payload)).try_cast("string")
    exp = F.try_variant_get(F.try_parse_json(decoded), "$.exp", "bigint")
    now_s = F.unix_seconds(now.cast("timestamp"))
    return tokens.withColumn("expires_at_s", exp).withColumns(
        {
            "hours_left": F.floor((F.col("expires_at_s") - now_s) / 3600).cast("bigint"),
            "expired": F.col("expires_at_s") <= now_s,
        }
    )


def token_lifetime(events: DataFrame, session: str = "session") -> DataFrame:
    """Observed lifetime per session: first expiry minus the time it was verified.

    ``events``: session, ``ts``, ``kind`` (``verified`` or ``expired``).
    """
    verified = F.min(F.when(F.col("kind") == "verified", F.col("ts")))
    expired = F.min(F.when(F.col("kind") == "expired", F.col("ts")))
    return (
        events.groupBy(session)
        .agg(verified.alias("verified_at"), expired.alias("expired_at"))
        .withColumn(
            "lifetime_s",
            F.floor(
                (
                    F.unix_micros(F.col("expired_at").cast("timestamp"))
                    - F.unix_micros(F.col("verified_at").cast("timestamp"))
                )
                / 1_000_000
            ).cast("bigint"),
        )
    )
