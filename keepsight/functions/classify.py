"""Messages and exit codes to failure classes, as ordered first-match rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Failure codes and their exit codes.
EXIT_CODE_BY_FAILURE = {
    "none": 0,
    "unknown": 1,
    "usage-error": 2,
    "cli-missing": 10,
    "auth-missing": 11,
    "scan-failed": 12,
    "upload-failed": 13,
    "download-failed": 14,
    "verify-failed": 15,
    "delete-sync-failed": 16,
    "state-write-failed": 17,
    "state-read-failed": 18,
    "timeout": 19,
    "interrupted": 20,
    "provider-error": 21,
}

# Meaning of an exit code, by who returned it. The two namespaces
# use 10, 11 and 12 for different things.
ENGINE_EXIT_MEANINGS = {
    0: "ok",
    1: "fatal",
    3: "partial",
    10: "repo-missing",
    11: "repo-locked",
    12: "wrong-password",
    130: "clean-stop",
}

# Transport error phrases. An account tier block is tested first,
# because no login can cure it.
TIER_BLOCKED = r"(?i)not allowed for this user tier|status 402|402 payment required"
AUTH_EXPIRED = (
    r"(?i)config reconnect|empty token found|failed to get token|mnemonic is required"
)


def failure_rules(provider: str = "") -> list[tuple[str, tuple[str, ...]]]:
    """Ordered ``(code, phrases)`` rules; the first rule with a phrase present wins.

    ``provider`` is the storage provider's name as its messages spell it. Left
    empty, the two provider rules match the phrase whatever the name.
    """
    name = provider.strip().lower()
    # The phrases of each failure code, in order of precedence.
    return [
        (
            "usage-error",
            (
                "source directory is required",
                "--source is required",
                "--target is required",
                "invalid cron expression",
            ),
        ),
        ("cli-missing", (f"{name} cli not found",)),
        ("auth-missing", (f"not authenticated with {name}",)),
        ("delete-sync-failed", ("delete sync failed",)),
        ("verify-failed", ("restore verification failed", "checksum mismatches")),
        ("download-failed", ("files could not be downloaded",)),
        ("upload-failed", ("backup failed", "uploads did not complete")),
        ("timeout", ("timed out", "timeout")),
        ("interrupted", ("interrupted", "sigint", "sigterm")),
    ]


def classify_failure(
    message: Column, rules: Sequence[tuple[str, Sequence[str]]] | None = None
) -> Column:
    """Failure code of a message; text that no rule knows is ``unknown``."""
    text = F.lower(message)
    chain = F.when(message.isNull(), F.lit("none"))
    for code, phrases in rules if rules is not None else failure_rules():
        hit = F.lit(False)
        for phrase in phrases:
            hit = hit | text.contains(phrase)
        chain = chain.when(hit, F.lit(code))
    return chain.otherwise(F.lit("unknown"))


def exit_code_of(code: Column) -> Column:
    """Exit code of a failure code; null for a code outside the taxonomy."""
    table = F.create_map(*[F.lit(x) for pair in EXIT_CODE_BY_FAILURE.items() for x in pair])
    return F.try_element_at(table, code)


def classify_engine_exit_col(exit_code: Column) -> Column:
    """Meaning of a backup engine exit code; anything undocumented is ``unknown``."""
    table = F.create_map(*[F.lit(x) for pair in ENGINE_EXIT_MEANINGS.items() for x in pair])
    return F.when(exit_code.isNotNull(), F.coalesce(
        F.try_element_at(table, exit_code.cast("int")), F.lit("unknown")
    ))


def classify_transport(text: Column) -> Column:
    """``tier_blocked``, ``auth_expired`` or ``other``."""
    return (
        F.when(text.rlike(TIER_BLOCKED), F.lit("tier_blocked"))
        .when(text.rlike(AUTH_EXPIRED), F.lit("auth_expired"))
        .otherwise(F.lit("other"))
    )
