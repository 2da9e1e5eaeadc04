"""Text columns: units, timetables, failure classes, redaction, tokens."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from keepsight.functions.redaction import MARKER
from keepsight.functions.sql import register_functions
from keepsight.operators import events as ev
from keepsight.operators import normalise, redaction
from keepsight.operators.mapping import map_with_errors
from keepsight.plans import tables as t
from keepsight.plans.registry import query

NOW = dt.datetime(2024, 1, 16)

SIZE_SUFFIXES = ["", "K", " m", "GiB", "TB", "X", "BiB", ".5G", " 2 G", "kb"]
_SIZE_CASE = """CASE p_partkey % 10
    WHEN 0 THEN p_size::BIGINT WHEN 1 THEN p_size::BIGINT * 1024 WHEN 2 THEN p_size::BIGINT * 1048576
    WHEN 3 THEN p_size::BIGINT * 1073741824 WHEN 6 THEN p_size::BIGINT
    WHEN 7 THEN (p_size::BIGINT * 2 + 1) * 536870912 END"""
_SIZE_REASON = """CASE p_partkey % 10 WHEN 4 THEN 'ambiguous_decimal' WHEN 9 THEN 'ambiguous_decimal'
    WHEN 5 THEN 'unknown_suffix' WHEN 8 THEN 'malformed' END"""


@query(
    "normalise_sizes",
    f"""SELECT p_partkey, '  ' || p_size || {t.pick_sql("p_partkey", SIZE_SUFFIXES)} || ' ' AS raw,
          CAST({_SIZE_CASE} AS BIGINT) AS value, {_SIZE_REASON} AS reason FROM part""",
)
def normalise_sizes(spark, sf_dir):
    raw = F.concat(
        F.lit("  "), F.col("p_size").cast("string"), t.pick(F.col("p_partkey"), SIZE_SUFFIXES), F.lit(" ")
    )
    texts = t.table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    good, bad = normalise.normalise_sizes(texts, "raw")
    return good.unionByName(bad, allowMissingColumns=True)


DURATION_SUFFIXES = ["s", " M", "h", "d", "", "w", ".25h", " soon now"]


@query(
    "normalise_durations",
    f"""SELECT p_partkey, p_size || {t.pick_sql("p_partkey", DURATION_SUFFIXES)} AS raw,
          CAST(CASE p_partkey % 8 WHEN 0 THEN p_size::BIGINT * 1000 WHEN 1 THEN p_size::BIGINT * 60000
            WHEN 2 THEN p_size::BIGINT * 3600000 WHEN 3 THEN p_size::BIGINT * 86400000
            WHEN 6 THEN p_size::BIGINT * 3600000 + 900000 END AS BIGINT) AS value,
          CASE p_partkey % 8 WHEN 4 THEN 'bare_number' WHEN 5 THEN 'unknown_unit' WHEN 7 THEN 'malformed' END AS reason
        FROM part""",
)
def normalise_durations(spark, sf_dir):
    raw = F.concat(F.col("p_size").cast("string"), t.pick(F.col("p_partkey"), DURATION_SUFFIXES))
    texts = t.table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    good, bad = normalise.normalise_durations(texts, "raw")
    return good.unionByName(bad, allowMissingColumns=True)


_ENTRIES = """SELECT p_partkey, 0 AS pos, CASE p_partkey % 4 WHEN 2 THEN NULL
      ELSE lpad(CAST(p_size AS VARCHAR), 2, '0') || ':30' END AS hhmm,
    CASE p_partkey % 4 WHEN 2 THEN p_size || 'M' ELSE 'off' END AS rate FROM part
  UNION ALL SELECT p_partkey, 1, CASE p_partkey % 4 WHEN 1 THEN '8:00' ELSE '08:00' END,
    CASE p_partkey % 4 WHEN 3 THEN 'fast' ELSE p_size || 'M' END FROM part WHERE p_partkey % 4 <> 2"""


@query(
    "timetable_audit",
    f"""SELECT p_partkey, CAST(pos AS INT) AS pos, hhmm, rate,
          CASE WHEN hhmm IS NOT NULL AND NOT regexp_full_match(hhmm, '([01][0-9]|2[0-3]):[0-5][0-9]') THEN 'bad_time'
            WHEN rate = 'fast' THEN 'bad_rate' END AS error FROM ({_ENTRIES})""",
)
def timetable_audit(spark, sf_dir):
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    rate = F.concat(size, F.lit("M"))
    entry = F.concat(
        F.lpad(size, 2, "0"),
        F.lit(":30,off  "),
        F.when(kind == 1, F.lit("8:00,")).otherwise(F.lit("08:00,")),
        F.when(kind == 3, F.lit("fast")).otherwise(rate),
    )
    texts = t.table(spark, sf_dir, "part").select(
        "p_partkey", F.when(kind == 2, rate).otherwise(entry).alias("raw")
    )
    return normalise.timetable_audit(texts, "raw").drop("raw")


MESSAGES = [
    "Source directory is required", "Storage CLI not found", "Not authenticated with storage",
    "Delete sync failed: 1 remote deletions did not complete.",
    "Restore verification failed: 1 files had checksum mismatches.",
    "2 files could not be downloaded", "Backup failed: 2 uploads did not complete.",
    "request TIMED OUT", "got SIGTERM, stopping", "disk is full",
]
_CODES = [
    "usage-error", "cli-missing", "auth-missing", "delete-sync-failed", "verify-failed",
    "download-failed", "upload-failed", "timeout", "interrupted", "unknown",
]
_EXITS = [2, 10, 11, 16, 15, 14, 13, 19, 20, 1]


@query(
    "classify_failures",
    f"""SELECT event_id, {t.pick_sql("event_id + user_id", MESSAGES)} || ' (' || event_type || ')' AS message,
          {t.pick_sql("event_id + user_id", _CODES)} AS failure_code,
          CAST({t.pick_sql("event_id + user_id", _EXITS)} AS INT) AS exit_code FROM events""",
)
def classify_failures(spark, sf_dir):
    text = F.concat(
        t.pick(F.col("event_id") + F.col("user_id"), MESSAGES), F.lit(" ("), "event_type", F.lit(")")
    )
    messages = t.events(spark, sf_dir).select("event_id", text.alias("message"))
    return ev.classify_failures(messages, "message", "storage")


EXITS = [0, 1, 3, 10, 11, 12, 130, 99]
_MEANINGS = [
    "ok", "fatal", "partial", "repo-missing", "repo-locked", "wrong-password", "clean-stop", "unknown",
]


@query(
    "classify_engine_exit",
    f"""SELECT event_id, CAST({t.pick_sql("event_id + user_id", EXITS)} AS INT) AS code,
          {t.pick_sql("event_id + user_id", _MEANINGS)} AS meaning FROM events""",
)
def classify_engine_exit(spark, sf_dir):
    codes = t.events(spark, sf_dir).select(
        "event_id", t.pick(F.col("event_id") + F.col("user_id"), EXITS).alias("code")
    )
    return ev.classify_engine_exit(codes, "code")


STDERR = {
    "error": "CRITICAL: failed to get token - please run: config reconnect ix: - Empty token found",
    "signup": "Fatal error: access not allowed for this user tier (status 402)",
    "purchase": "login failed, token: 402 Payment Required; failed to get token",
    "view": "mnemonic is REQUIRED",
}
_CLASS = {
    "error": "auth_expired",
    "signup": "tier_blocked",
    "purchase": "tier_blocked",
    "view": "auth_expired",
}


@query(
    "classify_transport_errors",
    f"""SELECT event_id, {t.case_sql("event_type", STDERR, "connection reset by peer")} AS line,
          {t.case_sql("event_type", _CLASS, "other")} AS transport_class FROM events""",
)
def classify_transport_errors(spark, sf_dir):
    lines = t.events(spark, sf_dir).select(
        "event_id",
        t.case_of(F.col("event_type"), STDERR, "connection reset by peer").alias("line"),
    )
    return ev.classify_transport_errors(lines, "line")


@query(
    "first_auth_expiry",
    """SELECT user_id AS run_id, min('t' || lpad(CAST(event_id % 1000 AS VARCHAR), 4, '0') || '.err') AS file
       FROM events WHERE event_type IN ('error', 'purchase', 'view') GROUP BY user_id""",
)
def first_auth_expiry(spark, sf_dir):
    name = F.concat(F.lit("t"), F.lpad((F.col("event_id") % 1000).cast("string"), 4, "0"), F.lit(".err"))
    artefacts = t.events(spark, sf_dir).select(
        F.col("user_id").alias("run_id"),
        name.alias("file"),
        t.case_of(F.col("event_type"), STDERR, "connection reset by peer").alias("text"),
    )
    return ev.first_auth_expiry(artefacts)


# the same three shapes, with white space spelled out for the checking dialect
_WS = "\\x{0009}-\\x{000D} \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"
_PAT_A = f"\\b((?i:pass|password|mnemonic|token|secret))[{_WS}]*=[{_WS}]*[^{_WS}]+"
_PAT_B = (
    f"\\b(RCLONE_CONFIG_[A-Z0-9_]*(?:PASS|MNEMONIC|TOKEN)|RESTIC_PASSWORD|BWS_ACCESS_TOKEN)"
    f"[{_WS}]*=[{_WS}]*[^{_WS}]+"
)
_PAT_C = "\\b[\\w.+-]+@[\\w-]+\\.[\\w.-]+\\b"


def shapes_sql(text: str) -> str:
    one = f"regexp_replace({text}, '{_PAT_A}', '\\1 = [redacted]', 'g')"
    two = f"regexp_replace({one}, '{_PAT_B}', '\\1=[redacted]', 'g')"
    return f"regexp_replace({two}, '{_PAT_C}', '[redacted]', 'g')"


def known_sql(text: str) -> str:
    return f"list_reduce(list_prepend({text}, vals), lambda x, y: replace(x, y, '[redacted]'))"


_SECRETS = """secrets AS (SELECT list(value ORDER BY length(value) DESC, value) AS vals FROM (
    SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9a-f]{40}')) AS value FROM documents))"""


def tokens_in(docs):
    """The 40-digit tokens that occur in ``text``."""
    found = F.regexp_extract_all("text", F.lit("[0-9a-f]{40}"), F.lit(0))
    return docs.select(F.explode(found).alias("value")).distinct()


def _secrets(spark, sf_dir):
    """Registered values: the tokens of all documents."""
    return tokens_in(t.table(spark, sf_dir, "documents"))


@query(
    "redact",
    f"""WITH {_SECRETS} SELECT doc_id, {shapes_sql(known_sql("text"))} AS text
        FROM documents, secrets""",
)
def redact(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "text")
    return redaction.redact(docs, ["text"], _secrets(spark, sf_dir))


@query(
    "redact_many_secrets",
    f"""WITH {_SECRETS} SELECT doc_id, {shapes_sql(known_sql("text"))} AS text
        FROM documents, secrets""",
)
def redact_many_secrets(spark, sf_dir):
    """``redact`` with values in blocks, as where they are too many for one pass."""
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = _secrets(spark, sf_dir)
    size = found.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()[0]
    return redaction.redact(docs, ["text"], found, block_bytes=max(size // 2, 1))


@query(
    "redact_conversations",
    f"SELECT conv_id, turn, role, {shapes_sql('text')} AS text FROM conversations",
)
def redact_conversations(spark, sf_dir):
    return redaction.redact(t.table(spark, sf_dir, "conversations"), ["text"])


_COUNT = "len(regexp_extract_all({x}, '\\[redacted\\]'))"
REGISTERED = ["assistant", "the benchmark", "Lorem ipsum", "example.com"]


def _registered_sql(text: str) -> str:
    for value in sorted(REGISTERED, key=lambda v: (-len(v), v)):
        text = f"replace({text}, '{value}', '{MARKER}')"
    return text


@query(
    "redaction_report",
    f"""WITH r AS (SELECT source, text, {_registered_sql("text")} AS known FROM documents),
          s AS (SELECT *, {shapes_sql("known")} AS after FROM r)
        SELECT source, count(*) AS rows, count(*) FILTER (text <> after) AS rows_changed,
          CAST(sum({_COUNT.format(x="known")} - {_COUNT.format(x="text")}) AS BIGINT) AS known_markers,
          CAST(sum({_COUNT.format(x="after")} - {_COUNT.format(x="known")}) AS BIGINT) AS shape_markers
        FROM s GROUP BY source""",
)
def redaction_report(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents").select("source", "text")
    return redaction.redaction_report(docs, "text", "source", REGISTERED)


@query(
    "token_expiry_audit",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN s END AS expires_at_s,
         CASE WHEN event_type <> 'error' THEN CAST(floor((s - epoch(TIMESTAMP '2024-01-16')) / 3600) AS BIGINT) END AS hours_left,
         CASE WHEN event_type <> 'error' THEN s <= epoch(TIMESTAMP '2024-01-16') END AS expired
       FROM (SELECT *, CAST(epoch_us(ts) // 1000000 AS BIGINT) + user_id AS s FROM events)""",
)
def token_expiry_audit(spark, sf_dir):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")) + F.col("user_id")
    payload = F.concat(F.lit('{"sub":"\u00fc\u00ff>>??","exp":'), seconds.cast("string"), F.lit("}"))
    encoded = F.translate(F.base64(payload.cast("binary")), "+/=", "-_")
    body = F.when(F.col("event_type") == "error", F.lit("not*a*payload")).otherwise(encoded)
    tokens = t.events(spark, sf_dir).select(
        "event_id", F.concat(F.lit("e30."), body, F.lit(".sig")).alias("token")
    )
    return ev.token_expiry_audit(tokens, "token", F.lit(NOW)).drop("token")


@query(
    "token_lifetime",
    """SELECT user_id AS session, min(ts) FILTER (event_type = 'signup') AS verified_at,
         min(ts) FILTER (event_type = 'error') AS expired_at,
         CAST(floor((epoch_us(min(ts) FILTER (event_type = 'error'))
           - epoch_us(min(ts) FILTER (event_type = 'signup'))) / 1000000) AS BIGINT) AS lifetime_s
       FROM events GROUP BY user_id""",
)
def token_lifetime(spark, sf_dir):
    kinds = {"signup": "verified", "error": "expired"}
    observed = t.events(spark, sf_dir).select(
        F.col("user_id").alias("session"), "ts", t.case_of(F.col("event_type"), kinds).alias("kind")
    )
    return ev.token_lifetime(observed)


@query(
    "map_with_errors",
    """SELECT event_id, event_type <> 'error' AS success,
         CASE WHEN event_type <> 'error' THEN CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) * 2 END AS value,
         CASE WHEN event_type = 'error' THEN 'unusable event' END AS error
       FROM events""",
)
def map_with_errors_query(spark, sf_dir):
    def double(row: dict) -> int:
        if row["event_type"] == "error":
            raise ValueError("unusable event")
        return int(row["k"]) * 2

    rows = t.events(spark, sf_dir).select("event_id", "event_type", t.k_of().alias("k"))
    return map_with_errors(rows, double, "bigint", "event_id")


@query(
    "register_functions",
    f"""SELECT p_partkey, CAST({_SIZE_CASE} AS BIGINT) AS size_bytes,
          {t.pick_sql("p_partkey", _CODES)} AS failure_code,
          CAST({t.pick_sql("p_partkey", _EXITS)} AS INT) AS failure_exit,
          {shapes_sql("'token = ' || p_name || ' for ' || p_brand")} AS redacted FROM part""",
)
def register_functions_query(spark, sf_dir):
    register_functions(spark, "storage")
    parts = t.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.col("p_size").cast("string"), t.pick(F.col("p_partkey"), SIZE_SUFFIXES)).alias("raw"),
        t.pick(F.col("p_partkey"), MESSAGES).alias("message"),
        F.concat(F.lit("token = "), "p_name", F.lit(" for "), "p_brand").alias("note"),
    )
    return parts.selectExpr(
        "p_partkey",
        "size_bytes(raw) AS size_bytes",
        "failure_code(message) AS failure_code",
        "failure_exit(failure_code(message)) AS failure_exit",
        "redact_text(note) AS redacted",
    )
