"""The fleet's tables, derived from the driver's: in Spark, and as SQL for the check.

``events`` stands in for runs, snapshots, quota readings and log lines (``user_id``
is the source), ``documents`` for file contents, ``pages`` for file paths,
``orders`` and ``lineitem`` for run reports, ``part`` for configuration documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsight.sources.shared import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, the way a fleet keeps logs and documents.

    Operators then read plain columns instead of working out the derivation again
    in every filter the optimizer pushes down. Written in one piece per core: a
    small input file would otherwise leave all later work to one task.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.repartition(spark.sparkContext.defaultParallelism).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pick(index: Column, words: list) -> Column:
    """The word at ``index`` modulo the number of words."""
    return F.get(F.array(*[F.lit(w) for w in words]), F.pmod(index, F.lit(len(words))).cast("int"))


def pick_sql(index: str, words: list) -> str:
    items = ", ".join("'" + w.replace("'", "''") + "'" if isinstance(w, str) else str(w) for w in words)
    return f"([{items}])[CAST(({index}) % {len(words)} AS INT) + 1]"


def case_of(col: Column, cases: dict, default=None) -> Column:
    chain = F
    for key, value in cases.items():
        chain = chain.when(col == key, F.lit(value))
    return chain.otherwise(F.lit(default))


def case_sql(col: str, cases: dict, default=None) -> str:
    def lit(v):
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in cases.items())
    return f"CASE {col} {whens} ELSE {lit(default)} END"


STATUS = {"error": "failure", "signup": "partial"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def k_of(props: str = "props") -> Column:
    return F.get_json_object(props, "$.k").cast("bigint")


def bytes_of(value: str = "value") -> Column:
    return F.round(F.col(value) * 1_000_000).cast("bigint")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("user_id").alias("host"), F.col("event_id").alias("snapshot_id"), "ts"
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    took = F.make_dt_interval(secs=F.lit(60) + F.floor(F.col("value") * 10))
    return events(spark, sf_dir).select(
        F.col("event_id").alias("run_id"),
        F.col("user_id").alias("source"),
        F.col("ts").alias("started_at"),
        (F.col("ts") + took).alias("finished_at"),
        case_of(F.col("event_type"), STATUS, "success").alias("status"),
        (k_of() * 10).alias("files"),
        bytes_of().alias("bytes"),
    )


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("source"),
        (F.col("c_nationkey") * 10).cast("bigint").alias("min_files"),
        F.round(F.abs("c_acctbal") * 1000).cast("bigint").alias("min_bytes"),
        (F.col("c_nationkey") * 4).cast("int").alias("max_shrink_pct"),
    )


def verify_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("user_id").alias("repo"),
        F.col("event_id").alias("run_id"),
        "ts",
        (~F.col("event_type").isin("error", "signup")).alias("ok"),
        (F.pmod(k_of(), F.lit(8)) + 1).cast("int").alias("shard"),
    )


def quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("user_id").alias("repo"),
        F.col("ts").alias("taken_at"),
        F.when(F.col("event_type") != "error", bytes_of() + F.col("event_id") * 1000).alias("used"),
        F.lit(500_000_000).cast("bigint").alias("total"),
    )


_TYPES = {"purchase": "summary", "click": "status", "view": "status", "error": "error"}


def event_text() -> Column:
    """A log line: JSON, or noise, or a line cut off in the middle."""
    amount = F.when(k_of() < 10, F.lit("null")).when(k_of() < 20, F.lit("false")).otherwise(
        bytes_of().cast("string")
    )
    json = F.concat(
        F.lit('{"message_type":"'), case_of(F.col("event_type"), _TYPES, "status"),
        F.lit('","run":'), F.col("user_id").cast("string"),
        F.lit(',"line":'), F.col("event_id").cast("string"),
        F.lit(',"bytes_done":'), amount, F.lit("}"),
    )
    return (
        F.when(k_of() >= 95, F.concat(F.lit("NOTICE: line "), F.col("event_id").cast("string")))
        .when(k_of() >= 90, F.substring(json, 1, 24))
        .otherwise(json)
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"),
        event_text().alias("value"),
    )


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: path, hash and size."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"),
        F.concat(F.lit("./"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        F.sha2("text", 256).alias("sha256"),
        F.octet_length("text").cast("bigint").alias("bytes"),
        "lang",
        "source",
    )


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: the URL without scheme, query and fragment, as a path."""
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(F.lit("/"), F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1)).alias("path"),
        "url",
    )


REPORT_STATUS = {"F": "success", "O": "partial", "P": "failure"}
REPORT_FAILURE = {"F": "none", "O": "upload-failed", "P": "timeout"}
MODES = ["backup", "restore"]


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as run reports, flat."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_custkey").alias("source"),
        F.col("o_orderdate").alias("started_at"),
        pick(F.col("o_custkey"), MODES).alias("mode"),
        case_of(F.col("o_orderstatus"), REPORT_STATUS).alias("status"),
        case_of(F.col("o_orderstatus"), REPORT_FAILURE).alias("failure_code"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("duration_ms"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("failed_files"),
    )


CTE = {
    "snapshots": "SELECT user_id AS host, event_id AS snapshot_id, ts FROM events",
    "runs": f"""
        SELECT event_id AS run_id, user_id AS source, ts AS started_at,
          ts + to_seconds(CAST(60 + floor(value * 10) AS BIGINT)) AS finished_at,
          {case_sql("event_type", STATUS, "success")} AS status,
          CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) * 10 AS files,
          CAST(round(value * 1000000) AS BIGINT) AS bytes
        FROM events""",
    "bands": """
        SELECT c_custkey AS source, CAST(c_nationkey * 10 AS BIGINT) AS min_files,
          CAST(round(abs(c_acctbal) * 1000) AS BIGINT) AS min_bytes,
          CAST(c_nationkey * 4 AS INT) AS max_shrink_pct
        FROM customer""",
    "verify_runs": """
        SELECT user_id AS repo, event_id AS run_id, ts,
          event_type NOT IN ('error', 'signup') AS ok,
          CAST(CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) % 8 + 1 AS INT) AS shard
        FROM events""",
    "quota": """
        SELECT user_id AS repo, ts AS taken_at,
          CASE WHEN event_type <> 'error'
            THEN CAST(round(value * 1000000) AS BIGINT) + event_id * 1000 END AS used,
          CAST(500000000 AS BIGINT) AS total
        FROM events""",
    "log_lines": f"""
        SELECT user_id AS run_id, event_id AS line_no, k,
          {case_sql("event_type", _TYPES, "status")} AS message_type,
          CASE WHEN k >= 20 THEN CAST(round(value * 1000000) AS BIGINT) END AS bytes_done,
          k < 10 AS is_null, k BETWEEN 10 AND 19 AS is_false, k < 90 AS readable
        FROM (SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM events)""",
    "contents": """
        SELECT doc_id AS file_id, './' || source || '/' || doc_id AS path,
          sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, lang, source
        FROM documents""",
    "page_paths": """
        SELECT page_id, '/' || regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path, url FROM pages""",
    "reports": f"""
        SELECT o_orderkey AS run_id, o_custkey AS source, o_orderdate AS started_at,
          {pick_sql("o_custkey", MODES)} AS mode,
          {case_sql("o_orderstatus", REPORT_STATUS)} AS status,
          {case_sql("o_orderstatus", REPORT_FAILURE)} AS failure_code,
          CAST(round(o_totalprice * 100) AS BIGINT) AS duration_ms,
          CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS failed_files
        FROM orders""",
}


def with_tables(*names: str, body: str, **extra: str) -> str:
    """``body`` behind common table expressions for the named tables."""
    parts = [f"{n} AS ({CTE[n]})" for n in names] + [f"{n} AS ({q})" for n, q in extra.items()]
    return f"WITH {', '.join(parts)} {body}"
