"""Remove secrets from text: registered values first, then credential shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepsight.functions.chars import (
    BOUNDARY,
    NON_SPACE_CLASS,
    SPACE_CLASS,
    WORD,
    WORD_START,
    let,
)

# The marker, the shortest value redacted by exact match, and the
# three credential shapes.
MARKER = "[redacted]"
MIN_SECRET_CHARS = 8
ASSIGNMENT = (
    rf"{WORD_START}((?i:pass|password|mnemonic|token|secret))"
    rf"{SPACE_CLASS}*={SPACE_CLASS}*{NON_SPACE_CLASS}+"
)
ENVIRONMENT = (
    rf"{WORD_START}(RCLONE_CONFIG_[A-Z0-9_]*(?:PASS|MNEMONIC|TOKEN)|RESTIC_PASSWORD|BWS_ACCESS_TOKEN)"
    rf"{SPACE_CLASS}*={SPACE_CLASS}*{NON_SPACE_CLASS}+"
)
EMAIL = rf"{BOUNDARY}[{WORD}.+-]+@[{WORD}-]+\.[{WORD}.-]+{BOUNDARY}"

MARKER_PATTERN = r"\[redacted\]"


def usable_secrets(values: Sequence[str | None]) -> list[str]:
    """Distinct values worth matching, longest first (ties by value).

    Values inside the marker itself are left out: replacing them would nest
    markers without hiding anything.
    """
    kept = {v for v in values if v and len(v) >= MIN_SECRET_CHARS and v not in MARKER}
    return sorted(kept, key=lambda v: (-len(v), v))


def redact_known(text: Column, secrets: Sequence[str]) -> Column:
    """Literal replacement of each registered value, longest first."""
    for value in usable_secrets(secrets):
        text = F.replace(text, F.lit(value), F.lit(MARKER))
    return text


def redact_shapes(text: Column) -> Column:
    """Credential assignments, transport variables and e-mail addresses.

    A row without ``=`` or ``@`` cannot match, so the regexes run only where
    they might fire.
    """

    def assignments(t: Column) -> Column:
        named = F.regexp_replace(t, ASSIGNMENT, f"$1 = {MARKER}")
        return F.regexp_replace(named, ENVIRONMENT, f"$1={MARKER}")

    def addresses(t: Column) -> Column:
        return F.when(t.contains("@"), F.regexp_replace(t, EMAIL, MARKER)).otherwise(t)

    assigned = F.when(text.contains("="), assignments(text)).otherwise(text)
    return let(assigned, addresses)


def marker_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(MARKER_PATTERN)).cast("bigint")
