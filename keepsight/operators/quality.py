"""Constraint checks over tables of JSON documents.

Every check returns ``violations(id, path, rule, message)`` and reports all it
finds. Checks on one document are column expressions over a VARIANT: no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsight.functions.chars import SPACE_CLASS, let, strip
from keepsight.functions.units import (
    HHMM,
    parse_duration,
    parse_size,
    size_from_number,
    timetable_error,
)

# Keys a configuration document may hold, per section.
KNOWN_KEYS = {
    "root": [
        "schema_version", "repo", "secrets", "source", "schedule",
        "retention", "verify", "bandwidth", "limits", "reports",
    ],
    "repo": [
        "backend", "remote", "path", "cache_dir", "tmp_dir", "rclone_config",
        "rclone_program", "restic_program", "pack_size_mib", "connections",
        "append_only_backups",
    ],
    "secrets": ["provider", "command", "variable", "retries", "retry_delay"],
    "source": [
        "name", "path", "tags", "exclude", "exclude_caches", "exclude_if_present",
        "one_file_system", "min_files", "min_bytes", "max_shrink_pct",
    ],
    "schedule": ["timezone", "backup", "verify", "prune", "drill"],
    "retention": [
        "keep_last", "keep_daily", "keep_weekly", "keep_monthly", "keep_yearly",
        "group_by", "max_unused", "max_repack_size",
    ],
    "verify": ["structural_every_run", "read_data_subset_divisor", "cursor_file"],
    "bandwidth": ["timetable", "tps_limit", "tps_limit_burst", "window_stop"],
    "limits": ["read_concurrency", "backup_timeout", "verify_timeout", "prune_timeout"],
    "reports": ["dir", "keep", "keep_days"],
}

# Defaults of a configuration document. The transport's remote
# name is the site's own and has no default here.
DEFAULTS = {
    "schema_version": 1,
    "repo.backend": "rclone",
    "repo.cache_dir": "/cache/restic",
    "repo.tmp_dir": "/cache/tmp",
    "repo.rclone_config": "/state/rclone.conf",
    "repo.rclone_program": "/usr/local/bin/rclone",
    "repo.restic_program": "/usr/local/bin/restic",
    "repo.pack_size_mib": 128,
    "repo.connections": 4,
    "repo.append_only_backups": True,
    "secrets.provider": "prompt",
    "secrets.retries": 10,
    "secrets.retry_delay": "30s",
    "schedule.timezone": "UTC",
    "schedule.backup": "0 2 * * *",
    "schedule.verify": "0 5 * * 0",
    "schedule.prune": "0 4 1 */3 *",
    "schedule.drill": "0 6 1 */3 *",
    "retention.keep_last": 3,
    "retention.keep_daily": 7,
    "retention.keep_weekly": 4,
    "retention.keep_monthly": 12,
    "retention.keep_yearly": 3,
    "retention.group_by": "host,paths",
    "retention.max_unused": "5%",
    "retention.max_repack_size": "20G",
    "verify.structural_every_run": False,
    "verify.read_data_subset_divisor": 52,
    "verify.cursor_file": "/state/verify-cursor.json",
    "limits.read_concurrency": 2,
    "limits.backup_timeout": "20h",
    "limits.verify_timeout": "8h",
    "limits.prune_timeout": "12h",
    "reports.dir": "/state/reports",
    "reports.keep": 200,
    "reports.keep_days": 400,
}

# Names that must not hold a value in a document, the form of a
# source name, and the version this build reads.
CREDENTIAL_KEY = r"(?i)password|passphrase|secret|mnemonic|token|api_?key|credential"
SOURCE_NAME = r"\A[a-zA-Z0-9][A-Za-z0-9_.-]*\z"
ABSOLUTE_PATH = r"\A/"
SCHEMA_VERSION = 1
EXPLODE_STEPS = 8
PROTECTED_KEYS = ["rclone_config", "cache_dir", "tmp_dir"]


@dataclass(frozen=True)
class Rule:
    """What one key must look like. ``kind`` is one of the names in ``_KINDS``."""

    path: str
    kind: str
    required: bool = False
    min: int | None = None
    max: int | None = None
    allowed: tuple | None = None
    pattern: str | None = None


# Kinds and bounds of the document's keys.
CONFIG_RULES = [
    Rule("repo", "table"),
    Rule("repo.backend", "text", allowed=("rclone",)),
    Rule("repo.remote", "text"),
    Rule("repo.path", "text", required=True),
    Rule("repo.cache_dir", "text"),
    Rule("repo.tmp_dir", "text"),
    Rule("repo.rclone_config", "text", pattern=r"\A(?!\s*/dev/null\s*\z)"),
    Rule("repo.rclone_program", "text"),
    Rule("repo.restic_program", "text"),
    Rule("repo.pack_size_mib", "integer", min=4, max=128),
    Rule("repo.connections", "integer", min=1, max=64),
    Rule("repo.append_only_backups", "boolean"),
    Rule("secrets", "table"),
    Rule("secrets.provider", "text", allowed=("env", "command", "prompt")),
    Rule("secrets.command", "text"),
    Rule("secrets.variable", "text"),
    Rule("secrets.retries", "integer", min=1, max=100),
    Rule("secrets.retry_delay", "duration"),
    Rule("source", "tables", required=True),
    Rule("schedule", "table"),
    Rule("schedule.timezone", "text"),
    Rule("schedule.backup", "text"),
    Rule("schedule.verify", "text"),
    Rule("schedule.prune", "text"),
    Rule("schedule.drill", "text"),
    Rule("retention", "table"),
    Rule("retention.keep_last", "integer", min=1),
    Rule("retention.keep_daily", "integer", min=0),
    Rule("retention.keep_weekly", "integer", min=0),
    Rule("retention.keep_monthly", "integer", min=0),
    Rule("retention.keep_yearly", "integer", min=0),
    Rule("retention.group_by", "text"),
    Rule("retention.max_unused", "text"),
    Rule("retention.max_repack_size", "text"),
    Rule("verify", "table"),
    Rule("verify.structural_every_run", "boolean"),
    Rule("verify.read_data_subset_divisor", "integer", min=1, max=365),
    Rule("verify.cursor_file", "text"),
    Rule("bandwidth", "table"),
    Rule("bandwidth.timetable", "timetable"),
    Rule("bandwidth.tps_limit", "integer", min=1),
    Rule("bandwidth.tps_limit_burst", "integer", min=1),
    Rule("bandwidth.window_stop", "text", pattern=HHMM),
    Rule("limits", "table"),
    Rule("limits.read_concurrency", "integer", min=1, max=64),
    Rule("limits.backup_timeout", "duration"),
    Rule("limits.verify_timeout", "duration"),
    Rule("limits.prune_timeout", "duration"),
    Rule("reports", "table"),
    Rule("reports.dir", "text"),
    Rule("reports.keep", "integer", min=1),
    Rule("reports.keep_days", "integer", min=1),
]
SOURCE_RULES = [
    Rule("name", "text", required=True, pattern=SOURCE_NAME),
    Rule("path", "text", required=True, pattern=ABSOLUTE_PATH),
    Rule("tags", "texts"),
    Rule("exclude", "texts"),
    Rule("exclude_caches", "boolean"),
    Rule("exclude_if_present", "texts"),
    Rule("one_file_system", "boolean"),
    Rule("min_files", "integer", required=True, min=0),
    Rule("min_bytes", "size", required=True),
    Rule("max_shrink_pct", "integer", required=True, min=0, max=100),
]


def json_path(path: str) -> str:
    return "$" if not path else "$." + path


def value_at(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, json_path(path), "variant")


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


_PLAIN_PATH = r"\A\w+(?:\.\w+)*\Z"


def _levels(paths: Sequence[str]) -> dict[int, str]:
    """A struct type for each depth of ``paths``, with a variant at the end of each path."""
    trees: dict[int, dict] = {}
    for path in paths:
        if re.match(_PLAIN_PATH, path, re.ASCII):
            node = trees.setdefault(path.count("."), {})
            *above, last = path.split(".")
            for key in above:
                node = node.setdefault(key, {})
            node[last] = None

    def kind(node: dict | None) -> str:
        return "variant" if node is None else f"struct<{','.join(f'`{k}`:{kind(v)}' for k, v in node.items())}>"

    return {depth: kind(node) for depth, node in trees.items()}


def with_values(doc: Column, paths: Sequence[str], use: Callable[[Mapping[str, Column]], Column]) -> Column:
    """``use`` of the values at ``paths``, as ``value_at`` gives them, read in one pass for each depth."""
    levels = _levels(paths)
    read = [F.try_variant_get(doc, "$", kind).alias(f"_{depth}") for depth, kind in levels.items()]

    def at(found: Column, path: str) -> Column:
        if not re.match(_PLAIN_PATH, path, re.ASCII):
            return value_at(doc, path)
        value = found[f"_{path.count('.')}"]
        for key in path.split("."):
            value = value.getField(key)
        return value

    return let(F.struct(*read, F.lit(0)), lambda found: use({path: at(found, path) for path in paths}))


def kind_of(value: Column) -> Column:
    """``OBJECT`` or ``ARRAY``, or the type of a scalar, at the cost of one level.

    The schema of a whole value is worked out by recursion, which one deep document
    is enough to overflow.
    """
    return (
        F.when(_as(value, "struct<_:variant>").isNotNull(), F.lit("OBJECT"))
        .when(_as(value, "array<struct<_:variant>>").isNotNull(), F.lit("ARRAY"))
        .otherwise(F.schema_of_variant(value))
    )


def _is_text(kind: Column) -> Column:
    return kind == "STRING"


def _is_number(kind: Column) -> Column:
    return kind.rlike(r"\A(?:BIGINT|DOUBLE|FLOAT|DECIMAL)")


def _wrong_kind(rule: Rule, value: Column, kind: Column) -> Column:
    """Reason a present value is not of the rule's kind, or null."""
    if rule.kind == "text":
        bad = ~_is_text(kind) | _as(value, "string").rlike(rf"\A{SPACE_CLASS}*\z")
        return F.when(bad, F.lit("expected a non-empty string"))
    if rule.kind == "string":
        return F.when(~_is_text(kind), F.lit("expected a string"))
    if rule.kind == "text_or_null":
        return F.when(~kind.isin("STRING", "VOID"), F.lit("expected a string or null"))
    if rule.kind == "integer":
        number = _as(value, "double")
        whole = (kind == "BIGINT") | (_is_number(kind) & (number == F.floor(number)))
        return F.when(~whole, F.lit("expected an integer"))
    if rule.kind == "boolean":
        return F.when(kind != "BOOLEAN", F.lit("expected true or false"))
    if rule.kind == "table":
        return F.when(~kind.startswith("OBJECT"), F.lit("expected a table"))
    if rule.kind in ("texts", "tables"):
        want = "STRING" if rule.kind == "texts" else "OBJECT"
        items = F.try_variant_get(value, "$", "array<variant>")
        fits = F.forall(items, lambda item: kind_of(item) == want)
        fits = fits & (F.size(items) > 0) if rule.kind == "tables" else fits
        return F.when(
            ~kind.startswith("ARRAY") | ~fits,
            F.lit(
                "expected an array of strings"
                if rule.kind == "texts"
                else "expected at least one table"
            ),
        )
    text = _as(value, "string")
    if rule.kind == "size":
        reason = F.when(_is_text(kind), parse_size(text)["reason"]).otherwise(
            F.when(_is_number(kind), size_from_number(_as(value, "double"))["reason"]).otherwise(
                F.lit("malformed")
            )
        )
        return F.concat(F.lit("size: "), reason)
    if rule.kind == "duration":
        reason = F.when(_is_text(kind), parse_duration(text)["reason"]).otherwise(
            F.lit("bare_number")
        )
        return F.concat(F.lit("duration: "), reason)
    if rule.kind == "timetable":
        reason = F.when(_is_text(kind), timetable_error(text)).otherwise(F.lit("malformed"))
        return F.concat(F.lit("timetable: "), reason)
    raise ValueError(f"unknown kind {rule.kind!r}")


def finding(rule_name: str, message: Column, path: Column) -> Column:
    return F.struct(
        path.alias("path"), F.lit(rule_name).alias("rule"), message.alias("message")
    )


def _rule_finding(rule: Rule, value: Column, kind: Column, prefix: Column) -> Column:
    """The first thing wrong with one key, or null."""
    path = F.concat(prefix, F.lit(rule.path))

    def judge() -> Column:
        missing = finding("required", F.lit("is required"), path) if rule.required else F.lit(None)
        wrong = _wrong_kind(rule, value, kind)
        # a parsed text is worth a name; the other reasons are cheap to work out again
        parsed = rule.kind in ("size", "duration", "timetable")
        judged = let(wrong, lambda w: beyond(value, w)) if parsed else beyond(value, wrong)
        return F.when(value.isNull(), missing).otherwise(judged)

    def beyond(value: Column, wrong: Column) -> Column:
        """Bounds and form, once the kind is right."""
        chain = F.when(wrong.isNotNull(), finding("type", wrong, path))
        bounded = rule.min is not None or rule.max is not None
        worded = rule.allowed is not None or rule.pattern is not None
        number = _as(value, "double") if bounded else None
        text = strip(_as(value, "string")) if worded else None
        if rule.min is not None:
            chain = chain.when(
                number < rule.min, finding("min", F.lit(f"must be at least {rule.min}"), path)
            )
        if rule.max is not None:
            chain = chain.when(
                number > rule.max, finding("max", F.lit(f"must be at most {rule.max}"), path)
            )
        if rule.allowed is not None:
            words = ", ".join(map(str, rule.allowed))
            chain = chain.when(
                ~text.isin(*map(str, rule.allowed)),
                finding("enum", F.lit(f"expected one of {words}"), path),
            )
        if rule.pattern is not None:
            chain = chain.when(
                ~text.rlike(rule.pattern), finding("pattern", F.lit("has the wrong form"), path)
            )
        return chain

    return judge()


_FINDING = "struct<path:string,rule:string,message:string>"


def findings(*found: Column) -> Column:
    return F.array_compact(F.array(*found)).cast(f"array<{_FINDING}>")


def exploded(docs: DataFrame, id_col: str, findings: Column) -> DataFrame:
    return docs.select(id_col, F.explode(findings).alias("_v")).select(id_col, "_v.*")


def rule_findings(
    doc: Column,
    rules: Sequence[Rule],
    prefix: Column,
    more: Callable[[Mapping[str, Column], Mapping[str, Column]], Sequence[Column]] = lambda values, kinds: (),
) -> Column:
    """Each value and its kind are worked out once, by name: a rule mentions them many times.

    ``more`` makes further findings, or nulls, of the values and kinds by path.
    """
    paths = list(dict.fromkeys(rule.path for rule in rules))

    def judged(values: Mapping[str, Column]) -> Column:
        kinds = F.struct(*[F.when(values[p].isNotNull(), kind_of(values[p])).alias(f"_{n}") for n, p in enumerate(paths)])

        def found(all_kinds: Column) -> Column:
            kind = {p: all_kinds[f"_{n}"] for n, p in enumerate(paths)}
            each = [_rule_finding(rule, values[rule.path], kind[rule.path], prefix) for rule in rules]
            return findings(*each, *more(values, kind))

        return let(kinds, found)

    return with_values(doc, paths, judged)


def check_required_type_range(
    docs: DataFrame,
    rules: Sequence[Rule] = CONFIG_RULES,
    id_col: str = "doc_id",
    doc_col: str = "doc",
    prefix: Column | None = None,
) -> DataFrame:
    """Required keys, kinds, bounds, allowed values and forms, one finding per key."""
    start = F.lit("") if prefix is None else prefix
    return exploded(docs, id_col, rule_findings(F.col(doc_col), rules, start))


def check_enum(
    docs: DataFrame, path: str, allowed: Sequence[str], id_col: str = "doc_id", doc_col: str = "doc"
) -> DataFrame:
    """Value present but outside the allowed set."""
    return check_required_type_range(
        docs, [Rule(path, "string", allowed=tuple(allowed))], id_col, doc_col
    )


def check_pattern(
    docs: DataFrame, path: str, regex: str, id_col: str = "doc_id", doc_col: str = "doc"
) -> DataFrame:
    """Value present but not of the given form; anchor ``regex`` with ``\\A`` and ``\\z``."""
    return check_required_type_range(docs, [Rule(path, "string", pattern=regex)], id_col, doc_col)


def _version_finding(doc: Column, version: int | str, path: str) -> Column:
    found = value_at(doc, path)
    kind = kind_of(found)
    if isinstance(version, str):
        same = _is_text(kind) & (_as(found, "string") == version)
    else:
        same = _is_number(kind) & (_as(found, "double") == version)
    wrong = found.isNotNull() & ~F.coalesce(same, F.lit(False))
    message = F.lit(f"this build reads version {version}")
    return F.when(wrong, finding("schema_version", message, F.lit(path)))


def check_schema_version(
    docs: DataFrame,
    version: int | str = SCHEMA_VERSION,
    path: str = "schema_version",
    id_col: str = "doc_id",
    doc_col: str = "doc",
) -> DataFrame:
    """Documents of another version; an absent version means the current one."""
    finding = _version_finding(F.col(doc_col), version, path)
    return exploded(docs, id_col, findings(finding))


def _conditional_finding(doc: Column, when_path: str, value: str, then_path: str) -> Column:
    chosen = strip(F.try_variant_get(doc, json_path(when_path), "string")) == value
    message = F.lit(f"is required when {when_path} is {value}")
    return F.when(
        chosen & value_at(doc, then_path).isNull(),
        finding("conditional_required", message, F.lit(then_path)),
    )


def check_conditional_required(
    docs: DataFrame,
    when_path: str,
    value: str,
    then_path: str,
    id_col: str = "doc_id",
    doc_col: str = "doc",
) -> DataFrame:
    """``then_path`` must be present where ``when_path`` has the given value."""
    finding = _conditional_finding(F.col(doc_col), when_path, value, then_path)
    return exploded(docs, id_col, findings(finding))


def section_items(
    docs: DataFrame, section: str, id_col: str = "doc_id", doc_col: str = "doc"
) -> DataFrame:
    """``(id, index, item)`` per element of an array section."""
    items = F.try_variant_get(doc_col, json_path(section), "array<variant>")
    return docs.select(id_col, F.posexplode(items).alias("index", "item"))


def _keys(node: Column) -> Column:
    """Keys of a table; none of anything else."""
    return F.coalesce(F.map_keys(_as(node, "map<string,variant>")), F.array().cast("array<string>"))


def _section_keys(doc: Column, known: Mapping[str, Sequence[str]]) -> Column:
    """``array<struct<section, path, keys>>`` of a document's known sections."""

    def entry(section: str, path: Column, node: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), path.alias("path"), _keys(node).alias("keys"))

    nodes = F.array(
        *[
            entry(s, F.lit("config" if s == "root" else s), value_at(doc, "" if s == "root" else s))
            for s in known
            if s != "source"
        ]
    )
    if "source" not in known:
        return nodes
    per_source = F.transform(
        _items(doc, "source"),
        lambda item, i: entry(
            "source", F.concat(F.lit("source["), i.cast("string"), F.lit("]")), item
        ),
    )
    return F.concat(nodes, per_source)


def _items(doc: Column, section: str) -> Column:
    items = F.try_variant_get(doc, json_path(section), "array<variant>")
    return F.coalesce(items, F.array().cast("array<variant>"))


def unknown_findings(doc: Column, known: Mapping[str, Sequence[str]]) -> Column:
    def strange(section: str, path: Column, node: Column) -> Column:
        words = F.array(*[F.lit(k) for k in known[section]])
        return F.transform(F.array_except(_keys(node), words), lambda k: let(_suggestion(k, known[section]), lambda hint: finding(
            "unknown_key",
            F.concat(F.lit("unknown key"), F.coalesce(F.concat(F.lit("; did you mean "), hint), F.lit(""))),
            F.concat_ws(".", path, k),
        )))

    sections = [s for s in known if s not in ("root", "source")]
    found = [F.array()]
    if "root" in known:
        found.append(strange("root", F.lit("config"), doc))
    if sections:
        found.append(with_values(
            doc, sections, lambda values: F.flatten(F.array(*[strange(s, F.lit(s), values[s]) for s in sections]))
        ))
    if "source" in known:
        found.append(F.flatten(F.transform(_items(doc, "source"), lambda item, i: strange(
            "source", F.concat(F.lit("source["), i.cast("string"), F.lit("]")), item
        ))))
    return F.concat(*[part.cast(f"array<{_FINDING}>") for part in found])


def check_unknown_keys(
    docs: DataFrame,
    known: Mapping[str, Sequence[str]] = KNOWN_KEYS,
    id_col: str = "doc_id",
    doc_col: str = "doc",
) -> DataFrame:
    """Keys a section does not define, with the nearest known key where there is one."""
    return exploded(docs, id_col, unknown_findings(F.col(doc_col), known))


def _suggestion(key: Column, known: Sequence[str], max_dist: int = 2) -> Column:
    """First known key, in dictionary order, that is close; not the closest one."""
    words = F.array(*[F.lit(k) for k in known])
    bare = F.replace(key, F.lit("_"), F.lit(""))
    close = F.filter(
        words,
        lambda k: (F.replace(k, F.lit("_"), F.lit("")) == bare)
        | (F.levenshtein(k, key, max_dist) >= 0),
    )
    return F.get(close, F.lit(0))


def suggest_key(
    unknown: DataFrame, known: Sequence[str], max_dist: int = 2, key: str = "key"
) -> DataFrame:
    """Adds ``suggestion``: equal but for underscores, or within ``max_dist`` edits.

    The dictionary is a fixed list, so this is a projection, not a join.
    """
    return unknown.withColumn("suggestion", _suggestion(F.col(key), known, max_dist))


def coverage_of_keys(
    docs: DataFrame,
    known: Mapping[str, Sequence[str]] = KNOWN_KEYS,
    doc_col: str = "doc",
) -> DataFrame:
    """Known keys that no document mentions."""
    seen = (
        docs.select(F.explode(_section_keys(F.col(doc_col), known)).alias("_n"))
        .select("_n.section", F.explode("_n.keys").alias("key"))
        .distinct()
    )
    rows = [(section, key) for section, keys in known.items() for key in keys]
    catalogue = docs.sparkSession.createDataFrame(rows, "section string, key string")
    return catalogue.join(seen, ["section", "key"], "left_anti")


def check_unique(items: DataFrame, doc_id: str, key: str, path: str = "source") -> DataFrame:
    """Values of ``key`` that occur more than once in a document."""
    return (
        items.groupBy(doc_id, key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter((F.col("_n") > 1) & F.col(key).isNotNull())
        .select(
            doc_id,
            F.lit(path).alias("path"),
            F.lit("unique").alias("rule"),
            F.concat(F.lit("duplicate "), F.lit(key), F.lit(" "), F.col(key)).alias("message"),
        )
    )


def apply_defaults(docs: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Fill absent columns and nulls with defaults; explicit values stay.

    A column named like ``section.key`` holds a document's value; see ``typed_columns``.
    """
    out = {}
    for name, default in defaults.items():
        fill = F.lit(default)
        out[name] = F.coalesce(F.col(f"`{name}`"), fill) if name in docs.columns else fill
    return docs.withColumns(out)


def typed_columns(
    docs: DataFrame, defaults: Mapping[str, object], doc_col: str = "doc"
) -> DataFrame:
    """A document's keys as columns, typed like their defaults."""
    names = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    return docs.select(
        *[c for c in docs.columns if c != doc_col],
        *[
            F.try_variant_get(doc_col, json_path(path), names[type(default)]).alias(path)
            for path, default in defaults.items()
        ],
    )


def credential_key_scan(
    df: DataFrame, json_col: str, id_col: str, steps: int = EXPLODE_STEPS
) -> DataFrame:
    """Scalar values under a name that looks like a credential, with their dotted path.

    ``json_col`` holds JSON text or a variant. One chain of outer explodes yields each
    leaf of a document once, in one pass. What is still nested after ``steps`` of them
    is walked to its end in Arrow batches, so a document of any depth is searched whole.
    Text that the parser refuses has no findings.
    """
    spark = df.sparkSession
    parsed = isinstance(df.schema[json_col].dataType, T.VariantType)
    first = F.col(json_col) if parsed else F.try_parse_json(json_col)
    rows = df.select(id_col, first.alias("_v0")).withColumn("_path", F.lit("")).withColumn(
        "_key", F.lit(None).cast("string")
    )
    for depth in range(1, steps + 1):
        last = f"_v{depth - 1}"
        step = spark.tvf.variant_explode_outer(F.col(last).outer()).toDF("_p", "_k", f"_v{depth}")
        here = (
            F.when(F.col("_p").isNull(), F.lit(""))
            .when(F.col("_k").isNull(), F.concat(F.lit("["), F.col("_p").cast("string"), F.lit("]")))
            .when(F.col("_path") == "", F.col("_k"))
            .otherwise(F.concat(F.lit("."), F.col("_k")))
        )
        # where a step finds no child, the value and key of the leaf stay
        rows = rows.lateralJoin(step).select(
            id_col,
            F.concat("_path", here).alias("_path"),
            F.when(F.col("_p").isNull(), F.col("_key")).otherwise(F.col("_k")).alias("_key"),
            F.when(F.col("_p").isNull(), F.col(last)).otherwise(F.col(f"_v{depth}")).alias(f"_v{depth}"),
        )
    value = F.col(f"_v{steps}")
    within = [F.size(_as(value, kind)) for kind in ("map<string,variant>", "array<variant>")]
    nested = F.coalesce(*within, F.lit(0)) > 0
    named = F.coalesce(*within).isNull() & F.col("_key").rlike(CREDENTIAL_KEY)
    left = rows.filter(nested | named).select(
        id_col, F.col("_path").alias("path"), F.when(nested, value).alias("_rest")
    )
    schema = T.StructType([df.schema[id_col], T.StructField("path", T.StringType())])
    return left.mapInArrow(_walked, schema).withColumn("rule", F.lit("credential"))


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths without a rest as they are; a rest's credentials under its path."""
    for batch in batches:
        at, paths = [], []
        for n, (path, rest) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            whole = rest is None or rest["value"] is None
            found = [path] if whole else _credential_paths(path, rest["value"], rest["metadata"])
            at += [n] * len(found)
            paths += found
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at, pa.int64())), pa.array(paths, pa.string())],
            [batch.schema.names[0], "path"],
        )


def _credential_paths(path: str, value: bytes, metadata: bytes) -> list[str]:
    """Dotted paths of credentials in a variant, whose binary form is walked without recursion."""

    def number(data: bytes, at: int, width: int) -> int:
        return int.from_bytes(data[at : at + width], "little")

    width = (metadata[0] >> 6) + 1
    names = 1 + width * (number(metadata, 1, width) + 2)  # where the keys' bytes begin

    def key(n: int) -> str:
        start, end = (number(metadata, 1 + width * (n + k), width) for k in (1, 2))
        return metadata[names + start : names + end].decode()

    found, ahead = [], [(path, "", 0)]
    while ahead:
        path, name, at = ahead.pop()
        kind, head = value[at] & 3, value[at] >> 2
        if kind < 2:  # a scalar
            if re.search(CREDENTIAL_KEY, name, re.ASCII):
                found.append(path)
            continue
        large = head >> (4 if kind == 2 else 2) & 1
        step, id_width = (head & 3) + 1, (head >> 2 & 3) + 1
        size = number(value, at + 1, 4 if large else 1)
        ids = at + 1 + (4 if large else 1)
        offsets = ids + size * id_width if kind == 2 else ids
        first = offsets + (size + 1) * step
        for n in range(size):
            child = first + number(value, offsets + n * step, step)
            if kind == 2:
                below = key(number(value, ids + n * id_width, id_width))
                ahead.append((f"{path}.{below}", below, child))
            else:
                ahead.append((f"{path}[{n}]", "", child))
    return found


def _policy_finding(doc: Column) -> Column:
    """As ``check_retention_safe``, on one document with defaults filled in."""

    def keep(name: str) -> Column:
        path = f"retention.keep_{name}"
        return F.coalesce(F.try_variant_get(doc, json_path(path), "bigint"), F.lit(DEFAULTS[path]))

    unsafe = keep("last") < 2
    for name in ("daily", "weekly", "monthly", "yearly"):
        unsafe = unsafe & (keep(name) == 0)
    message = F.lit("policy would keep a single snapshot")
    return F.when(unsafe, finding("retention_safe", message, F.lit("retention")))


def _named_sources(doc: Column) -> Column:
    return F.transform(
        _items(doc, "source"),
        lambda item: F.struct(
            strip(F.try_variant_get(item, "$.name", "string")).alias("name"),
            strip(F.try_variant_get(item, "$.path", "string")).alias("path"),
        ),
    )


def _duplicate_findings(sources: Column) -> Column:
    """As ``check_unique``, on the sources of one document."""
    names = F.filter(F.transform(sources, lambda s: s["name"]), lambda n: n.isNotNull())
    twice = F.filter(
        F.array_distinct(names), lambda n: F.size(F.filter(names, lambda m: m == n)) > 1
    )
    return F.transform(
        twice,
        lambda n: finding(
            "unique", F.concat(F.lit("duplicate name "), n), F.lit("source")
        ),
    )


def _containment_findings(doc: Column, sources: Column) -> Column:
    """As ``protected_path_check``, on the sources of one document."""
    targets = F.array(
        *[
            F.struct(
                F.lit(f"repo.{key}").alias("label"),
                F.coalesce(
                    strip(F.try_variant_get(doc, f"$.repo.{key}", "string")),
                    F.lit(DEFAULTS[f"repo.{key}"]),
                ).alias("path"),
            )
            for key in PROTECTED_KEYS
        ]
    )

    def of_source(source: Column) -> Column:
        root = F.concat(F.regexp_replace(source["path"], r"/\z", ""), F.lit("/"))
        return F.transform(
            F.filter(targets, lambda p: p["path"].startswith(root)),
            lambda p: finding(
                "protected_path",
                F.concat_ws(" ", source["name"], F.lit("contains"), p["label"]),
                F.lit("source"),
            ),
        )

    return F.flatten(F.transform(sources, of_source))


def validate_config(docs: DataFrame, id_col: str = "doc_id", doc_col: str = "doc") -> DataFrame:
    """Everything wrong with each configuration document, without a shuffle.

    A document that is not a table, or that could not be read (null), has that one finding.
    """
    def readable(doc: Column) -> Column:
        return F.coalesce(kind_of(doc) == "OBJECT", F.lit(False))

    def found(doc: Column) -> Column:
        single = findings(
            _version_finding(doc, SCHEMA_VERSION, "schema_version"),
            _conditional_finding(doc, "secrets.provider", "command", "secrets.command"),
            _policy_finding(doc),
        )
        per_source = F.flatten(
            F.transform(
                _items(doc, "source"),
                lambda item, i: rule_findings(
                    item, SOURCE_RULES, F.concat(F.lit("source["), i.cast("string"), F.lit("]."))
                ),
            )
        )
        sources = _named_sources(doc)
        kind = f"array<{_FINDING}>"
        parts = [
            single,
            rule_findings(doc, CONFIG_RULES, F.lit("")),
            per_source,
            unknown_findings(doc, KNOWN_KEYS),
            let(sources, _duplicate_findings),
            let(sources, lambda found: _containment_findings(doc, found)),
        ]
        empty = F.array().cast(kind)
        no_table = findings(finding("type", F.lit("expected a table"), F.lit("config")))
        every = F.concat(*[F.coalesce(part.cast(kind), empty) for part in parts])
        return F.when(readable(doc), every).otherwise(no_table)

    message = "must not be in the document; supply it through the environment"
    named = credential_key_scan(docs.filter(readable(F.col(doc_col))), doc_col, id_col)
    # one name for the document keeps this out of generated code, too large for the JVM to compile
    return exploded(docs, id_col, let(F.col(doc_col), found)).unionByName(
        named.withColumn("message", F.lit(message))
    )
