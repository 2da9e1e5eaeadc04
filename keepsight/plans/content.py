"""Inventories, manifests and content over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsight.operators import inventory as inv
from keepsight.plans import tables as t
from keepsight.plans.registry import query
from keepsight.sources.shared import shared_path

INCLUDE = ["**/*.html", "*/{en,fr}/**"]
EXCLUDE = ["**/spam-*/**", "m.*/**", "**/?"]


@query(
    "glob_filter",
    t.with_tables(
        "page_paths",
        p="SELECT page_id, substr(path, 2) AS path FROM page_paths",
        body="""SELECT page_id, path FROM p
          WHERE regexp_full_match(path, '(([^/]*/)*[^/]*\\.html)|([^/]*/(en|fr)/.*)')
            AND NOT regexp_full_match(path, '(([^/]*/)*spam-[^/]*/.*)|(m\\.[^/]*/.*)|(([^/]*/)*[^/])')""",
    ),
)
def glob_filter(spark, sf_dir):
    pages = t.page_paths(spark, sf_dir).select("page_id", F.substr("path", F.lit(2)).alias("path"))
    return inv.glob_filter(pages, "path", INCLUDE, EXCLUDE)


BY_SOURCE = {"src0": ["./src0/*[02468]"], "src1": ["**/1*", "**/2?"], "src7": ["**"]}


@query(
    "glob_filter_by_source",
    t.with_tables(
        "contents",
        body="""SELECT source, path FROM contents WHERE NOT (
            (source = 'src0' AND regexp_full_match(path, '\\./src0/[^/]*[02468]'))
            OR (source = 'src1' AND regexp_full_match(path, '(.*/)?(1[^/]*|2[^/])'))
            OR source = 'src7')""",
    ),
)
def glob_filter_by_source(spark, sf_dir):
    files = t.contents(spark, sf_dir).select("source", "path")
    return inv.glob_filter_by_source(files, "path", BY_SOURCE)


def _customer_patterns(spark, sf_dir):
    key, home = F.col("c_custkey"), F.concat(F.lit("./c"), F.col("c_custkey").cast("string"))
    globs = F.array(
        F.when(key % 4 == 0, F.concat(home, F.lit("/1-*/**"))).when(key % 4 == 1, F.lit("**/*7")),
        F.when(key % 4 < 3, F.concat(home, F.lit("/5-LOW/*[02468]"))),
        F.when(key % 4 == 2, F.concat(home, F.lit("/3-MEDIUM/**"))),
    )
    customers = t.table(spark, sf_dir, "customer")
    return customers.select(home.alias("source"), F.explode(F.array_compact(globs)).alias("pattern"))


@query(
    "glob_filter_by_table",
    """SELECT source, path FROM (
         SELECT './c' || o_custkey AS source, o_custkey % 4 AS k, o_orderpriority AS p, CAST(o_orderkey AS VARCHAR) AS f,
           './c' || o_custkey || '/' || o_orderpriority || '/' || o_orderkey AS path FROM orders)
       WHERE NOT (source IN (SELECT './c' || c_custkey FROM customer) AND (
         (k = 0 AND p LIKE '1-%') OR (k = 1 AND f LIKE '%7') OR (k < 3 AND p = '5-LOW' AND CAST(f AS BIGINT) % 2 = 0)
         OR (k = 2 AND p = '3-MEDIUM')))""",
)
def glob_filter_by_table(spark, sf_dir):
    """Every customer is a source with globs of its own."""
    source = F.concat(F.lit("./c"), F.col("o_custkey").cast("string"))
    path = F.concat_ws("/", source, "o_orderpriority", F.col("o_orderkey").cast("string"))
    files = t.table(spark, sf_dir, "orders").select(source.alias("source"), path.alias("path"))
    return inv.glob_filter_by_table(files, _customer_patterns(spark, sf_dir))


@query(
    "exclude_if_present",
    t.with_tables(
        "page_paths",
        inventory="""SELECT path FROM page_paths
          UNION ALL SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) || '/.nobackup'
          FROM page_paths WHERE url LIKE '%utm_source%'""",
        marked="SELECT regexp_replace(path, '/\\.nobackup$', '') AS dir FROM inventory WHERE path LIKE '%/.nobackup'",
        body="""SELECT path FROM inventory i WHERE NOT EXISTS (
          SELECT 1 FROM marked m WHERE starts_with(i.path, m.dir || '/'))""",
    ),
)
def exclude_if_present(spark, sf_dir):
    pages = t.page_paths(spark, sf_dir)
    marker = F.concat(inv.parent_dir(F.col("path")), F.lit("/.nobackup"))
    markers = pages.filter(F.col("url").contains("utm_source")).select(marker.alias("path"))
    return inv.exclude_if_present(pages.select("path").unionByName(markers.distinct()))


@query(
    "protected_path_check",
    t.with_tables(
        "page_paths",
        sources="""SELECT DISTINCT regexp_extract(path, '^/([^/]*)', 1) AS name,
            regexp_extract(path, '^(/[^/]*/[^/]*)', 1) || CASE WHEN path LIKE '%.html' THEN '/' ELSE '' END AS path
          FROM page_paths""",
        body="""SELECT s.name, s.path, p.page_id AS label, p.path AS protected_path
          FROM sources s JOIN page_paths p ON starts_with(p.path, regexp_replace(s.path, '/$', '') || '/')""",
    ),
)
def protected_path_check(spark, sf_dir):
    pages = t.page_paths(spark, sf_dir)
    sources = pages.select(
        F.regexp_extract("path", "^/([^/]*)", 1).alias("name"),
        F.concat(
            F.regexp_extract("path", "^(/[^/]*/[^/]*)", 1),
            F.when(F.col("path").endswith(".html"), "/").otherwise(""),
        ).alias("path"),
    ).distinct()
    protected = pages.select(F.col("page_id").alias("label"), F.col("path").alias("protected_path"))
    return inv.protected_path_check(sources, protected)


@query(
    "inventory_totals",
    t.with_tables(
        "contents",
        body="SELECT source, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM contents GROUP BY source",
    ),
)
def inventory_totals(spark, sf_dir):
    return inv.inventory_totals(t.contents(spark, sf_dir).select("source", "bytes"))


# the restored tree: Spanish files lost, French ones changed in place, new ones added
_RESTORED = """SELECT './' || source || '/' || doc_id AS path,
    sha256(CASE WHEN lang = 'fr' THEN translate(text, 'aeiou', 'eioua') ELSE text END) AS sha256,
    CAST(octet_length(encode(text)) AS BIGINT) AS size
  FROM documents WHERE lang <> 'es'
  UNION ALL SELECT './benchmark/' || item_id, sha256(text), CAST(octet_length(encode(text)) AS BIGINT) FROM benchmark"""
_ORIGINAL = "SELECT path, sha256, bytes AS size FROM contents"
_DIFF = """SELECT coalesce(a.path, b.path) AS path, a.sha256 AS left_sha256, b.sha256 AS right_sha256,
    CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed'
      WHEN a.sha256 = b.sha256 THEN 'identical' ELSE 'changed' END AS change
  FROM original a FULL OUTER JOIN restored b ON a.path = b.path"""


def _original(spark, sf_dir):
    return t.contents(spark, sf_dir).select("path", "sha256", F.col("bytes").alias("size"))


def _restored(spark, sf_dir):
    text = F.when(F.col("lang") == "fr", F.translate("text", "aeiou", "eioua")).otherwise(
        F.col("text")
    )
    size = F.octet_length("text").cast("bigint").alias("size")
    docs = (
        t.table(spark, sf_dir, "documents")
        .filter(F.col("lang") != "es")
        .select(
            F.concat_ws("/", F.lit("."), "source", F.col("doc_id").cast("string")).alias("path"),
            F.sha2(text, 256).alias("sha256"),
            size,
        )
    )
    added = t.table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("./benchmark/"), F.col("item_id").cast("string")).alias("path"),
        F.sha2("text", 256).alias("sha256"),
        size,
    )
    return docs.unionByName(added)


@query(
    "manifest_diff",
    t.with_tables("contents", original=_ORIGINAL, restored=_RESTORED, body=_DIFF),
)
def manifest_diff(spark, sf_dir):
    return inv.manifest_diff(_original(spark, sf_dir), _restored(spark, sf_dir))


@query(
    "manifest_gate",
    t.with_tables(
        "contents",
        original=_ORIGINAL,
        restored=_RESTORED,
        diff=_DIFF,
        body="""SELECT count(*) AS files, count(*) FILTER (change <> 'identical') AS differing,
          CASE WHEN count(*) FILTER (change <> 'identical') = 0 THEN 'PASS' ELSE 'FAIL' END AS gate FROM diff""",
    ),
)
def manifest_gate(spark, sf_dir):
    return inv.manifest_gate(manifest_diff(spark, sf_dir))


@query(
    "size_only_drift",
    t.with_tables(
        "contents",
        original=_ORIGINAL,
        restored=_RESTORED,
        body="""SELECT a.path, a.size, a.sha256 AS left_sha256, b.sha256 AS right_sha256
          FROM original a JOIN restored b ON a.path = b.path AND a.size = b.size AND a.sha256 <> b.sha256""",
    ),
)
def size_only_drift(spark, sf_dir):
    return inv.size_only_drift(_original(spark, sf_dir), _restored(spark, sf_dir))


_PRIOR = """SELECT sha256(text) AS sha256 FROM documents WHERE lang <> 'en'
  UNION ALL SELECT sha256(text) FROM benchmark
  UNION ALL SELECT sha256(text) FROM documents SEMI JOIN labels USING (doc_id)"""
_SEEN = """SELECT sha256, min(file_id) AS first_file, count(*) AS files, max(bytes) AS bytes
  FROM contents WHERE sha256 {op} (SELECT sha256 FROM prior) GROUP BY sha256"""


def _prior(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    labelled = docs.join(t.table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    parts = [docs.filter(F.col("lang") != "en"), t.table(spark, sf_dir, "benchmark"), labelled]
    hashes = [p.select(F.sha2("text", 256).alias("sha256")) for p in parts]
    return hashes[0].unionByName(hashes[1]).unionByName(hashes[2])


@query(
    "new_content",
    t.with_tables("contents", prior=_PRIOR, body=_SEEN.format(op="NOT IN")),
)
def new_content(spark, sf_dir):
    return inv.new_content(t.contents(spark, sf_dir), _prior(spark, sf_dir))


@query(
    "known_content",
    t.with_tables("contents", prior=_PRIOR, body=_SEEN.format(op="IN")),
)
def known_content(spark, sf_dir):
    return inv.known_content(t.contents(spark, sf_dir), _prior(spark, sf_dir))


@query(
    "content_dedup",
    """SELECT sha256(text) AS sha256, min(doc_id) AS survivor, count(*) AS copies,
         (count(*) - 1) * max(CAST(octet_length(encode(text)) AS BIGINT)) AS bytes_saved
       FROM documents GROUP BY 1""",
)
def content_dedup(spark, sf_dir):
    return inv.content_dedup(t.table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "distinct_content",
    """SELECT source, count(DISTINCT sha256(text)) AS contents, true AS sketch_agrees
       FROM documents GROUP BY source""",
)
def distinct_content(spark, sf_dir):
    counts = inv.distinct_content(t.table(spark, sf_dir, "documents"), "source", "text")
    # five standard errors of the sketch, and one for rounding
    close = F.abs(F.col("approx_contents") - F.col("contents")) <= F.col("contents") * 0.05 + 1
    return counts.select("source", "contents", close.alias("sketch_agrees"))


@query(
    "distinct_content_weekly",
    """SELECT event_type, date_trunc('week', ts) AS week, count(user_id || '/' || props) AS items, true AS sketch_agrees
       FROM events GROUP BY ALL""",
)
def distinct_content_weekly(spark, sf_dir):
    """Weeks from stored daily sketches, against exact counts, within five standard errors."""
    content = F.concat_ws("/", F.col("user_id").cast("string"), "props")
    content = F.when(F.col("user_id").isNotNull() & F.col("props").isNotNull(), content)
    events = t.events(spark, sf_dir).select("event_type", F.date_trunc("day", "ts").alias("day"), content.alias("content"))
    path = shared_path(spark, "content_sketches")
    inv.content_sketches(events, ["event_type", "day"], "content").write.parquet(path)
    week = F.date_trunc("week", "day").alias("week")
    merged = inv.merged_content(spark.read.parquet(path), ["event_type", week])
    exact = events.groupBy("event_type", week).agg(F.countDistinct("content").alias("contents"))
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"e.{c}")) for c in ("event_type", "week")]
    close = F.abs(F.col("approx_contents") - F.col("contents")) <= F.col("contents") * (5 * 1.04 / 2**7) + 1
    both = merged.alias("m").join(exact.alias("e"), same)
    return both.select("m.event_type", "m.week", "items", close.alias("sketch_agrees"))


@query(
    "paths_in_both",
    t.with_tables(
        "contents",
        restored=_RESTORED,
        body="SELECT path FROM contents INTERSECT SELECT path FROM restored",
    ),
)
def paths_in_both(spark, sf_dir):
    return inv.paths_in_both(t.contents(spark, sf_dir), _restored(spark, sf_dir))


@query(
    "paths_only_in",
    t.with_tables(
        "contents",
        restored=_RESTORED,
        body="SELECT path FROM contents EXCEPT SELECT path FROM restored",
    ),
)
def paths_only_in(spark, sf_dir):
    return inv.paths_only_in(t.contents(spark, sf_dir), _restored(spark, sf_dir))
