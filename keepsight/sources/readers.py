"""Tolerant readers. Each keeps what it cannot read on a second, quarantine side."""

from __future__ import annotations

import re
from collections.abc import Mapping
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsight.functions.chars import let
from keepsight.functions.classify import EXIT_CODE_BY_FAILURE
from keepsight.operators.quality import (
    Rule,
    exploded,
    finding,
    rule_findings,
    unknown_findings,
)
from keepsight.sources.schemas import (
    QUOTA,
    REPORT_COUNTS,
    REPORT_KEYS,
    REPORT_MODES,
    REPORT_STATUSES,
    REPORT_VERSION,
    RUN_REPORT,
)

# Kinds and bounds of a run report's fields.
REPORT_RULES = [
    Rule("schemaVersion", "text", required=True, allowed=(REPORT_VERSION,)),
    Rule("runId", "text", required=True),
    Rule("mode", "text", required=True, allowed=REPORT_MODES),
    Rule("status", "text", required=True, allowed=REPORT_STATUSES),
    Rule("startedAt", "text", required=True),
    Rule("finishedAt", "text", required=True),
    Rule("durationMs", "integer", required=True, min=0),
    Rule("command", "table", required=True),
    Rule("command.argv", "texts", required=True),
    Rule("command.version", "text", required=True),
    Rule("paths", "table", required=True),
    Rule("paths.source", "text", required=True),
    Rule("paths.target", "text", required=True),
    Rule("paths.pathFilter", "text_or_null"),
    Rule("paths.patternFilter", "text_or_null"),
    Rule("counts", "table", required=True),
    *[Rule(f"counts.{name}", "integer", required=True, min=0) for name in REPORT_COUNTS],
    Rule("counts.retriedOperations", "integer", min=0),
    Rule("exitCode", "integer", required=True, min=0),
    Rule("failureCode", "text", required=True, allowed=tuple(EXIT_CODE_BY_FAILURE)),
    Rule("warnings", "texts"),
    Rule("failedPaths", "texts"),
    Rule("artifacts", "table", required=True),
    Rule("artifacts.manifestPath", "text_or_null", required=True),
    Rule("artifacts.logPath", "text_or_null", required=True),
    Rule("artifacts.reportPath", "text_or_null"),
    Rule("artifacts.restoreDiffPath", "text_or_null"),
]


def file_stem(path: Column) -> Column:
    """File name without directories and without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)\z", 1), r"\.[^.]*\z", "")


def run_name(root: str) -> Column:
    """A file's path below ``root`` without its extension: runs of other folders stay apart.

    ``root`` may be a folder, a pattern or a single file, whose run is its bare name.
    """
    plain = re.sub(r"\A[A-Za-z][\w+.-]*:(?://[^/]*)?", "", root)
    head = re.split(r"[*?{\[]", plain, maxsplit=1)[0]
    folder = (head.rstrip("/") if head == plain else head.rpartition("/")[0]) + "/"
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    at = F.locate(folder, full)
    name = F.element_at(F.split(full, "/"), -1)
    below = F.when(at > 0, F.substr(full, at + len(folder))).otherwise(name)
    return F.regexp_replace(below, r"\.[^./]*\z", "")


def parse_event_lines(lines: DataFrame, raw: str = "value") -> DataFrame:
    """Adds ``event`` (variant); null where a line is not one JSON object.

    Noise lines and a cut-off last line are expected, so nothing here fails.
    """
    is_object = F.col(raw).rlike(r"\A[ \t\r\n]*\{")
    return lines.withColumn("event", F.when(is_object, F.try_parse_json(raw)))


def scan_event_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(events, rejects)`` of newline-delimited engine output, one file per run, folders included.

    ``line_no`` orders the lines of a file without a shuffle: a split is read in
    order by one task, and splits start at known offsets.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        run_name(path).alias("run_id"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("id"),
        ).alias("line_no"),
        "value",
    )
    parsed = parse_event_lines(lines)
    events = parsed.filter(F.col("event").isNotNull()).select("run_id", "line_no", "event")
    rejects = parsed.filter(F.col("event").isNull()).select(
        "run_id", "line_no", F.col("value").alias("raw")
    )
    return events, rejects


def scan_run_reports(
    spark: SparkSession, path: str, whole_files: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``(reports, violations)``: reports that keep the schema, and what is wrong with the rest.

    One JSON report per line, or per file with ``whole_files``. Unknown keys,
    wrong versions, unknown enum values and negative counts are violations; so are
    times that are none and numbers beyond their type (rule ``value``), so a report that
    keeps the schema has no value lost. A whole number may be written as ``2.0``.
    """
    text = spark.read.text(path, wholetext=whole_files).filter(F.trim("value") != "")
    # the digest names a report even where its own id is unreadable
    docs = text.select(
        F.sha2("value", 256).alias("doc_id"), "value", F.try_parse_json("value").alias("doc")
    )
    readable = F.col("doc").isNotNull() & F.ltrim("value").startswith("{")
    unreadable = F.array(finding("json", F.lit("not a JSON object"), F.lit("")))
    wrong = let(F.col("doc"), lambda doc: F.concat(
        rule_findings(doc, REPORT_RULES, F.lit(""), _lost_values), unknown_findings(doc, REPORT_KEYS)
    ))
    # equal texts have equal findings, so each line is judged where it lies, once
    violations = exploded(docs, "doc_id", F.when(readable, wrong).otherwise(unreadable))
    fits = F.when(F.when(readable, F.size(wrong) == 0), F.array("doc"))
    reports = (
        docs.select(F.explode(fits).alias("doc"))
        .select(_typed_report("doc").alias("r"))
        .select("r.*")
    )
    return reports, violations


def _typed_report(doc: str) -> Column:
    """The report's fields by their types; null where a value cannot be one of its type."""
    return F.try_variant_get(F.col(doc), "$", f"struct<{RUN_REPORT}>")


# Form of a time, and the fields that a type can lose.
_TIME = r"\A\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)\z"
_TIMES = ["startedAt", "finishedAt"]
_NUMBERS = {
    "durationMs": "bigint", "exitCode": "int",
    **{f"counts.{name}": "bigint" for name in [*REPORT_COUNTS, "retriedOperations"]},
}


def _lost_values(values: Mapping[str, Column], kinds: Mapping[str, Column]) -> list[Column]:
    """Findings for texts that are no time and numbers outside their type; all paths have a rule."""
    found = []
    for path in _TIMES:
        text = F.try_variant_get(values[path], "$", "string")
        bad = ~text.rlike(_TIME) | F.try_to_timestamp(F.upper(text)).isNull()
        found.append(F.when(kinds[path].eqNullSafe("STRING") & bad, finding("value", F.lit("is not a time"), F.lit(path))))
    for path, kind in _NUMBERS.items():
        number, typed = (F.try_variant_get(values[path], "$", k) for k in ("double", kind))
        beyond = typed.isNull() & number.isNotNull()
        if kind == "bigint":  # a whole number of this kind fits as it is
            beyond = F.coalesce(kinds[path] != "BIGINT", F.lit(False)) & beyond
        found.append(F.when(beyond, finding("value", F.lit(f"does not fit a {kind}"), F.lit(path))))
    return found


_MANIFEST_LINE = r"(?s)\A([0-9a-f]{64}) [ *](.+)\z"


def scan_manifest(spark: SparkSession, path: str, side: str) -> DataFrame:
    """``(path, sha256, side)`` of ``sha256␠␠path`` lines; other lines are in ``manifest_rejects``."""
    line = F.col("value")
    return (
        spark.read.text(path)
        .filter(line.rlike(_MANIFEST_LINE))
        .select(
            F.regexp_extract(line, _MANIFEST_LINE, 2).alias("path"),
            F.regexp_extract(line, _MANIFEST_LINE, 1).alias("sha256"),
            F.lit(side).alias("side"),
        )
    )


def manifest_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a manifest that are not ``sha256␠␠path``."""
    return spark.read.text(path).filter(~F.col("value").rlike(_MANIFEST_LINE))


def scan_file_inventory(
    spark: SparkSession, root: str, hash: bool = False, glob: str | None = None
) -> DataFrame:
    """``(path, bytes, modified_at[, sha256])`` of every file under ``root``.

    Contents are read only when ``hash`` asks for digests.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root)
    columns = [
        F.col("path"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified_at"),
    ]
    if hash:
        columns.append(F.sha2("content", 256).alias("sha256"))
    return files.select(*columns)


def scan_quota_history(spark: SparkSession, path: str) -> DataFrame:
    """Quota readings as a time series; an empty object gives nulls, and so does an unreadable line.

    A file is one object over any number of lines, or one object a line. The label
    comes from a ``quota-<label>.json`` name, the time from the file. Files of lines are
    split like any text; only files without one line that is an object by itself, which
    an indented object has none of, are read whole.
    """
    line = F.col("value")
    lines = spark.read.text(path).select("_metadata", "value").filter(F.trim(line) != "")
    alone = line.rlike(r"\A\{.*\}[ \t\r]*\z") & F.try_parse_json(line).isNotNull()
    kinds = lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.bool_or(alone).alias("by_line"))
    # paths of single readings; the driver lists these files for any read of them
    whole = [r["file"] for r in kinds.filter("NOT by_line").collect()]
    rows = lines
    if whole:
        kept = lines.join(kinds.filter("by_line"), F.col("_metadata.file_path") == F.col("file"), "left_semi")
        paths = [unquote(urlsplit(f).path) if f.startswith("file:") else unquote(f) for f in whole]
        single = spark.read.text(paths, wholetext=True).select("_metadata", "value").filter(F.trim(line) != "")
        rows = kept.select("_metadata", "value").union(single)
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return rows.withColumn("_reading", F.from_json("value", QUOTA)).select(
        F.regexp_replace(file_stem(name), r"\Aquota-", "").alias("label"),
        F.col("_metadata.file_modification_time").alias("taken_at"),
        "_reading.*",
    )


def scan_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Verdict ledger as written by ``append_ledger``."""
    return spark.read.schema(
        "test string, verdict string, message string, detail string, run_date date"
    ).json(path)
