"""The data-quality suite over configuration documents built from ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsight.operators import quality as q
from keepsight.plans import tables as t
from keepsight.plans.registry import query

RETENTION_KEYS = ["keep_daily", "keep_dayly", "keepweekly", "keep_month", "keep_yaerly", "holding"]
SECRET_KEYS = ["provider", "rclone_Token", "cache_dir", "API_KEY", "apikey", "path", "MyPassphrase"]


def documents(spark, sf_dir):
    """One JSON document per part; sizes and keys drift out of range on purpose."""
    key, size = F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    doc = F.concat(
        F.lit('{"schema_version":'), F.when(size > 45, F.lit("2")).otherwise(F.lit("1")),
        F.lit(',"repo":{'),
        F.when(size == 1, F.lit("")).otherwise(F.concat(F.lit('"path":"restic/'), "p_brand", F.lit('",'))),
        F.lit('"pack_size_mib":'), text(size * 4),
        F.when(size < 5, F.lit(".5")).otherwise(F.lit("")),
        F.lit(',"cache_dir":"/data/'), F.lower("p_type"), F.lit('/cache"},'),
        F.lit('"secrets":{"provider":"'),
        F.when(F.col("p_brand") == "Brand#1", F.lit("command")).when(F.col("p_brand") == "Brand#2", F.lit("vault"))
        .otherwise(F.lit("env")),
        F.lit('","'), t.pick(key, SECRET_KEYS), F.lit('":null,"retry_delay":"'), text(size),
        F.when(size % 7 == 0, F.lit("")).otherwise(F.lit("s")), F.lit('"},'),
        F.lit('"source":[{"name":"'), F.lower("p_type"), F.lit('","path":"/data/'), F.lower("p_type"),
        F.lit('","min_files":'), text(size - 3), F.lit(',"min_bytes":"'), text(size),
        F.when(size % 5 == 0, F.lit("GB")).otherwise(F.lit("G")), F.lit('","max_shrink_pct":'), text(size * 3),
        F.lit('},{"name":"'), F.when(size > 30, F.lower("p_type")).otherwise(F.lit("Other one")),
        F.lit('","path":"relative","tags":["a",{"secret":'), text(size), F.lit("}]"),
        F.lit(',"min_files":0,"min_bytes":7,"max_shrink_pct":0}],'),
        F.lit('"retention":{"keep_last":1,"keep_daily":0,"keep_weekly":0,"keep_monthly":0,"keep_yearly":'),
        F.when(size < 26, F.lit("0")).otherwise(F.lit("1")), F.lit(',"'), t.pick(key + 1, RETENTION_KEYS[1:]),
        F.lit('":7}}'),
    )
    parts = t.table(spark, sf_dir, "part")
    return parts.select(key.alias("doc_id"), doc.alias("json"))


_BOUNDS = """
  SELECT p_partkey AS doc_id, 'repo.path' AS path, 'required' AS rule, 'is required' AS message FROM part WHERE p_size = 1
  UNION ALL SELECT p_partkey, 'repo.pack_size_mib', 'type', 'expected an integer' FROM part WHERE p_size < 5
  UNION ALL SELECT p_partkey, 'repo.pack_size_mib', 'max', 'must be at most 128' FROM part WHERE p_size > 32
  UNION ALL SELECT p_partkey, 'secrets.provider', 'enum', 'expected one of env, command, prompt' FROM part WHERE p_brand = 'Brand#2'
  UNION ALL SELECT p_partkey, 'secrets.retry_delay', 'type', 'duration: bare_number' FROM part WHERE p_size % 7 = 0"""
_SOURCES = """
  SELECT p_partkey AS doc_id, 'source[0].min_files' AS path, 'min' AS rule, 'must be at least 0' AS message FROM part WHERE p_size < 3
  UNION ALL SELECT p_partkey, 'source[0].min_bytes', 'type', 'size: ambiguous_decimal' FROM part WHERE p_size % 5 = 0
  UNION ALL SELECT p_partkey, 'source[0].max_shrink_pct', 'max', 'must be at most 100' FROM part WHERE p_size > 33
  UNION ALL SELECT p_partkey, 'source[1].name', 'pattern', 'has the wrong form' FROM part WHERE p_size <= 30
  UNION ALL SELECT p_partkey, 'source[1].path', 'pattern', 'has the wrong form' FROM part
  UNION ALL SELECT p_partkey, 'source[1].tags', 'type', 'expected an array of strings' FROM part"""
_VERSION = """SELECT p_partkey AS doc_id, 'schema_version' AS path, 'schema_version' AS rule,
    'this build reads version 1' AS message FROM part WHERE p_size > 45"""
_CONDITION = """SELECT p_partkey AS doc_id, 'secrets.command' AS path, 'conditional_required' AS rule,
    'is required when secrets.provider is command' AS message FROM part WHERE p_brand = 'Brand#1'"""
_RETENTION = """SELECT p_partkey AS doc_id, 'retention' AS path, 'retention_safe' AS rule,
    'policy would keep a single snapshot' AS message FROM part WHERE p_size < 26"""
_DUPLICATES = """SELECT p_partkey AS doc_id, 'source' AS path, 'unique' AS rule,
    'duplicate name ' || lower(p_type) AS message FROM part WHERE p_size > 30"""
_PROTECTED = """SELECT p_partkey AS doc_id, 'source' AS path, 'protected_path' AS rule,
    lower(p_type) || ' contains repo.cache_dir' AS message FROM part"""


def _hint_sql(key: str, known: list[str]) -> str:
    words = ", ".join(f"'{k}'" for k in known)
    close = f"replace(k, '_', '') = replace({key}, '_', '') OR levenshtein(k, {key}) <= 2"
    return f"list_filter([{words}], lambda k: {close})[1]"


_RET_KEY = t.pick_sql("p_partkey + 1", RETENTION_KEYS[1:])
_SEC_KEY = t.pick_sql("p_partkey", SECRET_KEYS)
_UNKNOWN = f"""
  SELECT doc_id, 'retention.' || key AS path, 'unknown_key' AS rule,
    'unknown key' || coalesce('; did you mean ' || hint, '') AS message
  FROM (SELECT *, {_hint_sql("key", q.KNOWN_KEYS["retention"])} AS hint
    FROM (SELECT p_partkey AS doc_id, {_RET_KEY} AS key FROM part))
  UNION ALL SELECT p_partkey, 'secrets.' || {_SEC_KEY}, 'unknown_key', 'unknown key' FROM part
  WHERE {_SEC_KEY} <> 'provider'"""


def _docs(spark, sf_dir):
    # a second "provider" would make the document unreadable, so it is left out
    clean = F.replace("json", F.lit('"provider":null,'), F.lit(""))
    docs = documents(spark, sf_dir).select("doc_id", clean.alias("json"))
    return t.stored(docs, "documents").withColumn("doc", F.try_parse_json("json"))


@query("check_required_type_range", _BOUNDS)
def check_required_type_range(spark, sf_dir):
    return q.check_required_type_range(_docs(spark, sf_dir))


@query("check_required_type_range_sources", _SOURCES)
def check_required_type_range_sources(spark, sf_dir):
    items = q.section_items(_docs(spark, sf_dir), "source")
    where = F.concat(F.lit("source["), F.col("index").cast("string"), F.lit("]."))
    return q.check_required_type_range(items, q.SOURCE_RULES, doc_col="item", prefix=where)


@query(
    "check_enum",
    """SELECT p_partkey AS doc_id, 'secrets.provider' AS path, 'enum' AS rule,
         'expected one of env, command, prompt' AS message FROM part WHERE p_brand = 'Brand#2'""",
)
def check_enum(spark, sf_dir):
    return q.check_enum(_docs(spark, sf_dir), "secrets.provider", ["env", "command", "prompt"])


@query(
    "check_pattern",
    """SELECT p_partkey AS doc_id, 'repo.path' AS path, 'pattern' AS rule, 'has the wrong form' AS message
       FROM part WHERE p_size > 1 AND length(p_brand) = 7""",
)
def check_pattern(spark, sf_dir):
    return q.check_pattern(_docs(spark, sf_dir), "repo.path", r"\Arestic/Brand#[0-9]{2}\z")


@query("check_unknown_keys", _UNKNOWN)
def check_unknown_keys(spark, sf_dir):
    return q.check_unknown_keys(_docs(spark, sf_dir))


@query(
    "suggest_key",
    f"""SELECT *, {_hint_sql("key", q.KNOWN_KEYS["retention"])} AS suggestion
        FROM (SELECT p_partkey, {t.pick_sql("p_partkey + p_size", RETENTION_KEYS)} AS key FROM part)""",
)
def suggest_key(spark, sf_dir):
    keys = t.table(spark, sf_dir, "part").select(
        "p_partkey", t.pick(F.col("p_partkey") + F.col("p_size"), RETENTION_KEYS).alias("key")
    )
    return q.suggest_key(keys, q.KNOWN_KEYS["retention"])


@query(
    "check_unique",
    """SELECT l_orderkey AS doc_id, 'source' AS path, 'unique' AS rule, 'duplicate name ' || l_linenumber AS message
       FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def check_unique(spark, sf_dir):
    items = t.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("string").alias("name")
    )
    return q.check_unique(items, "doc_id", "name")


@query("check_conditional_required", _CONDITION)
def check_conditional_required(spark, sf_dir):
    return q.check_conditional_required(
        _docs(spark, sf_dir), "secrets.provider", "command", "secrets.command"
    )


@query("check_schema_version", _VERSION)
def check_schema_version(spark, sf_dir):
    return q.check_schema_version(_docs(spark, sf_dir))


_DEFAULTED = {"repo.pack_size_mib": 128, "repo.connections": 4, "repo.tmp_dir": "/cache/tmp",
              "retention.keep_yearly": 3, "verify.structural_every_run": False}


@query(
    "apply_defaults",
    """SELECT p_partkey AS doc_id, CASE WHEN p_size < 5 THEN 128 ELSE CAST(p_size * 4 AS BIGINT) END AS pack_size_mib,
         4 AS connections, '/cache/tmp' AS tmp_dir, CASE WHEN p_size < 26 THEN 0 ELSE 1 END AS keep_yearly,
         false AS structural_every_run FROM part""",
)
def apply_defaults(spark, sf_dir):
    # a fractional size is no integer: it is dropped here and reported by the checks
    docs = _docs(spark, sf_dir).withColumn(
        "doc", F.try_parse_json(F.regexp_replace("json", r"[0-9]+\.5,", "null,"))
    )
    typed = q.typed_columns(docs.select("doc_id", "doc"), _DEFAULTED)
    filled = q.apply_defaults(typed, _DEFAULTED)
    return filled.select(
        "doc_id", *[F.col(f"`{name}`").alias(name.split(".")[1]) for name in _DEFAULTED]
    )


# what the documents mention, apart from keys that are not known at all
_MENTIONED = {
    "root": ["schema_version", "repo", "secrets", "source", "retention"],
    "repo": ["path", "pack_size_mib", "cache_dir"],
    "secrets": ["provider", "retry_delay"],
    "source": ["name", "path", "tags", "min_files", "min_bytes", "max_shrink_pct"],
    "retention": ["keep_last", "keep_daily", "keep_weekly", "keep_monthly", "keep_yearly"],
}
_CATALOGUE = ", ".join(f"('{s}', '{k}')" for s, keys in q.KNOWN_KEYS.items() for k in keys)
_SEEN = " UNION ALL ".join(
    f"SELECT '{s}' AS section, '{k}' AS key FROM part" for s, keys in _MENTIONED.items() for k in keys
)


@query(
    "coverage_of_keys",
    f"SELECT section, key FROM (VALUES {_CATALOGUE}) AS c(section, key) EXCEPT ({_SEEN})",
)
def coverage_of_keys(spark, sf_dir):
    return q.coverage_of_keys(_docs(spark, sf_dir))


_CREDENTIALS = [k for k in SECRET_KEYS if k not in ("provider", "cache_dir", "path")]


_FOUND = f"""SELECT p_partkey AS doc_id, 'secrets.' || {_SEC_KEY} AS path, 'credential' AS rule FROM part
        WHERE {_SEC_KEY} IN ({", ".join(f"'{k}'" for k in _CREDENTIALS)})
        UNION ALL SELECT p_partkey, 'source[1].tags[1].secret', 'credential' FROM part"""


@query("credential_key_scan", _FOUND)
def credential_key_scan(spark, sf_dir):
    return q.credential_key_scan(_docs(spark, sf_dir), "json", "doc_id")


@query(
    "validate_config",
    " UNION ALL ".join(
        f"SELECT doc_id, path, rule, message FROM ({part})"
        for part in (
            _BOUNDS, _SOURCES, _VERSION, _CONDITION, _RETENTION, _DUPLICATES, _PROTECTED, _UNKNOWN,
            f"SELECT *, 'must not be in the document; supply it through the environment' AS message FROM ({_FOUND})",
        )
    ),
)
def validate_config(spark, sf_dir):
    return q.validate_config(_docs(spark, sf_dir))
