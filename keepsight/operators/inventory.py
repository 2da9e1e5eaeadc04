"""File inventories, manifests and content: filters, diffs and duplicates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsight.functions.globs import any_regex, glob_to_regex, literal_head, matches_any
from keepsight.operators.skew import salted_join

# Fixed value: default marker file.
DEFAULT_MARKERS = (".nobackup",)


def glob_filter(
    df: DataFrame, col: str, include: Sequence[str] = (), exclude: Sequence[str] = ()
) -> DataFrame:
    """Rows whose path matches an ``include`` glob (if any are given) and no ``exclude`` glob."""
    path = F.col(col)
    if include:
        df = df.filter(matches_any(path, include))
    if exclude:
        df = df.filter(~F.coalesce(matches_any(path, exclude), F.lit(False)))
    return df


def glob_filter_by_source(
    df: DataFrame, col: str, excludes: dict[str, Sequence[str]], source: str = "source"
) -> DataFrame:
    """As ``glob_filter``, with each source's own exclude globs."""
    dropped = F.lit(False)
    for name, patterns in excludes.items():
        if patterns:
            dropped = dropped | (
                (F.col(source) == name) & F.col(col).rlike(any_regex(patterns))
            )
    return df.filter(~F.coalesce(dropped, F.lit(False)))


#: Patterns of one source and head that one alternation holds at most.
PATTERNS_PER_REGEX = 64


def glob_index(patterns: DataFrame, source: str = "source", pattern: str = "pattern") -> DataFrame:
    """``source, head, regex``: a table of globs, keyed by the folders they start with.

    ``head`` is the literal part of a glob up to its last slash before any wildcard, without
    that slash; null if there is none, so the glob may match anywhere in its source. Globs of
    one source and head are joined to alternations of a bounded number. Rows with a null are
    no pattern.
    """

    def compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            globs = batch.column(1).to_pylist()
            heads = [literal_head(g) for g in globs]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(heads, pa.string()), pa.array([glob_to_regex(g) for g in globs], pa.string())],
                [source, "head", "regex"],
            )

    given = patterns.select(source, F.col(pattern).alias("_glob")).dropna().distinct()
    kind = given.schema[source].dataType.simpleString()
    single = given.mapInArrow(compiled, f"`{source}` {kind}, head string, regex string")
    keys = [source, "head"]
    parts = single.groupBy(*keys).agg(F.ceil(F.count("*") / PATTERNS_PER_REGEX).cast("int").alias("_parts"))
    same = (F.col("l.head").eqNullSafe(F.col("r.head"))) & (F.col(f"l.{source}") == F.col(f"r.{source}"))
    dealt = single.alias("l").join(parts.alias("r"), same).select("l.*", "_parts")
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64("regex"), F.col("_parts")))
    any_of = F.array_join(F.array_sort(F.collect_list("regex")), "|")
    return dealt.groupBy(*keys, "_part").agg(
        F.concat(F.lit(r"(?s)\A(?:"), any_of, F.lit(r")\z")).alias("regex")
    ).drop("_part")


def glob_filter_by_table(
    df: DataFrame, patterns: DataFrame, col: str = "path", source: str = "source", pattern: str = "pattern"
) -> DataFrame:
    """Rows that no exclude glob of their own source matches; ``patterns`` is a table of any size.

    A path meets only globs whose literal head is one of its folders, found by an
    equi-join on source and folder, so a regex runs on few paths. Each distinct path is
    tried once. Rows with a null path or source stay, and repeated rows stay repeated.
    """
    index = glob_index(patterns, source, pattern)
    path = F.col("_path")
    paths = df.select(F.col(source).alias("_source"), F.col(col).alias("_path")).dropna().distinct()
    anywhere = F.array(F.lit(None).cast("string"))
    folders = F.slice(_prefixes(path), F.lit(1), F.size(F.split(path, "/")) - 1)
    keyed = paths.withColumn("_head", F.explode(F.concat(anywhere, folders)))
    rules = index.select(F.col(source).alias("_of"), F.col("head").alias("_under"), "regex")
    rules = rules.withColumn("_under", F.coalesce("_under", F.lit("/")))  # no folder's name is a slash
    keyed = keyed.withColumn("_head", F.coalesce("_head", F.lit("/")))
    hit = (F.col("_source") == F.col("_of")) & (F.col("_head") == F.col("_under"))
    dropped = keyed.join(rules, hit).filter(F.rlike(path, F.col("regex"))).select("_source", "_path").distinct()
    return df.join(dropped, (F.col(source) == F.col("_source")) & (F.col(col) == F.col("_path")), "left_anti")


def parent_dir(path: Column) -> Column:
    """Directory of a path, without the trailing slash; empty for a top-level name."""
    return F.regexp_extract(path, r"(?s)\A(.*)/[^/]*\z", 1)


def _prefixes(path: Column) -> Column:
    """Every prefix of ``path`` that ends just before a slash, and ``path`` itself."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"),
    )


def exclude_if_present(
    inventory: DataFrame, markers: Sequence[str] = DEFAULT_MARKERS, path: str = "path"
) -> DataFrame:
    """Drop every file in or under a directory that holds a marker file.

    Ancestors are expanded once per directory, not per file, and both joins are
    salted: the root is an ancestor of everything, and one directory may hold a
    large share of the files.
    """
    directory = parent_dir(F.col(path))
    name = F.regexp_extract(path, r"(?s)([^/]*)\z", 1)
    marked = inventory.filter(name.isin(list(markers))).select(directory.alias("_above")).distinct()
    dirs = inventory.select(directory.alias("_dir")).distinct()
    under = dirs.withColumn("_above", F.explode(_prefixes(F.col("_dir"))))
    excluded = salted_join(under, marked, ["_above"], "left_semi", ["_dir"]).select("_dir").distinct()
    return salted_join(
        inventory.withColumn("_dir", directory), excluded, ["_dir"], "left_anti", [path]
    ).select(*inventory.columns)


def protected_path_check(
    sources: DataFrame, protected: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Sources (``name``, ``path``) whose tree contains a protected path (``label``, ``protected_path``).

    A tree contains a path when the tree's root is one of the path's ancestors,
    so this is an equi-join on ancestors, salted because all paths share the upper
    ones. ``by`` names shared columns, such as the document, inside which the check
    applies. One trailing slash is ignored.
    """
    parts = F.split("protected_path", "/")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"),
    )
    targets = protected.filter(F.size(parts) > 1).withColumn("_root", F.explode(ancestors))
    roots = sources.withColumn("_root", F.regexp_replace("path", r"/\z", ""))
    joined = salted_join(targets, roots, [*by, "_root"], "inner", ["label", "protected_path"])
    return joined.select(
        *by, "name", "path", "label", "protected_path"
    )


def inventory_totals(inventory: DataFrame, source: str = "source") -> DataFrame:
    """Files and bytes per source."""
    return inventory.groupBy(source).agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").cast("bigint").alias("bytes")
    )


def manifest_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Paths of two manifests (``path``, ``sha256``): added, removed, changed or identical."""
    a = left.select("path", F.col("sha256").alias("left_sha256"), F.lit(True).alias("_l"))
    b = right.select("path", F.col("sha256").alias("right_sha256"), F.lit(True).alias("_r"))
    change = (
        F.when(F.col("_l").isNull(), F.lit("added"))
        .when(F.col("_r").isNull(), F.lit("removed"))
        .when(F.col("left_sha256").eqNullSafe(F.col("right_sha256")), F.lit("identical"))
        .otherwise(F.lit("changed"))
    )
    return a.join(b, "path", "full_outer").select(
        "path", "left_sha256", "right_sha256", change.alias("change")
    )


def manifest_gate(diff: DataFrame) -> DataFrame:
    """One row: files compared, files that differ, and PASS only when none does."""
    return diff.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("change") != "identical").alias("differing"),
    ).withColumn(
        "gate", F.when(F.col("differing") == 0, F.lit("PASS")).otherwise(F.lit("FAIL"))
    )


def size_only_drift(left: DataFrame, right: DataFrame) -> DataFrame:
    """Files a size comparison calls unchanged although their content differs."""
    a = left.select("path", "size", F.col("sha256").alias("left_sha256"))
    b = right.select("path", F.col("size").alias("_size"), F.col("sha256").alias("right_sha256"))
    return (
        a.join(b, "path")
        .filter((F.col("size") == F.col("_size")) & (F.col("left_sha256") != F.col("right_sha256")))
        .drop("_size")
    )


def _contents(files: DataFrame) -> DataFrame:
    """One row per content hash: how many files hold it, the first of them, its size."""
    return files.groupBy("sha256").agg(
        F.min("file_id").alias("first_file"),
        F.count(F.lit(1)).alias("files"),
        F.max("bytes").alias("bytes"),
    )


def new_content(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Contents of this snapshot never stored before; their ``bytes`` are the incremental volume.

    Both sides shrink to one row per hash, combined map-side, so copies cost
    nothing and the join needs no exchange of its own.
    """
    return _contents(current).join(prior.select("sha256").distinct(), "sha256", "left_anti")


def known_content(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Contents of this snapshot that were stored before."""
    return _contents(current).join(prior.select("sha256").distinct(), "sha256", "left_semi")


def content_dedup(df: DataFrame, id_col: str, content: str) -> DataFrame:
    """Groups of exactly equal content: survivor (smallest id), copies, bytes saved.

    Only hash, id and size are shuffled, already combined per hash.
    """
    size = F.octet_length(content).cast("bigint")
    return (
        df.select(F.sha2(content, 256).alias("sha256"), id_col, size.alias("_size"))
        .groupBy("sha256")
        .agg(
            F.min(id_col).alias("survivor"),
            F.count(F.lit(1)).alias("copies"),
            F.max("_size").alias("_size"),
        )
        .select(
            "sha256",
            "survivor",
            "copies",
            ((F.col("copies") - 1) * F.col("_size")).alias("bytes_saved"),
        )
    )


def distinct_content(df: DataFrame, group: str, content: str, rsd: float = 0.01) -> DataFrame:
    """Distinct contents per group, exact and approximate.

    Repeats are removed first, so each sketch sees a content once and a group
    full of copies is already small when it is shuffled.
    """
    return (
        df.select(group, F.sha2(content, 256).alias("_sha"))
        .distinct()
        .groupBy(group)
        .agg(
            F.count("_sha").alias("contents"),
            F.approx_count_distinct("_sha", rsd).alias("approx_contents"),
        )
    )


def content_sketches(df: DataFrame, by: Sequence[str], content: str, lg_k: int = 14) -> DataFrame:
    """``by, items, sketch``: one mergeable distinct-count sketch per group, to be stored.

    A sketch has at most 2^``lg_k`` cells, whatever the group holds, and is built map-side
    from the contents as they come: nothing is made distinct before. Nulls are no content.
    """
    return df.groupBy(*by).agg(
        F.count(content).alias("items"), F.hll_sketch_agg(F.sha2(content, 256), F.lit(lg_k)).alias("sketch")
    )


def merged_content(sketches: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """``by, items, approx_contents`` over any coarser groups of stored ``content_sketches``.

    The standard error is 1.04 / sqrt(2^lg_k), however many sketches are merged.
    """
    return sketches.groupBy(*by).agg(
        F.sum("items").alias("items"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("approx_contents")
    )


def paths_in_both(left: DataFrame, right: DataFrame, path: str = "path") -> DataFrame:
    """Distinct paths present on both sides."""
    return left.select(path).intersect(right.select(path))


def paths_only_in(left: DataFrame, right: DataFrame, path: str = "path") -> DataFrame:
    """Distinct paths of ``left`` that ``right`` lacks."""
    return left.select(path).subtract(right.select(path))


def ledger_union(*ledgers: DataFrame) -> DataFrame:
    """All ledgers together; a column one of them lacks is null there."""
    if not ledgers:
        raise ValueError("at least one ledger is needed")
    out = ledgers[0]
    for ledger in ledgers[1:]:
        out = out.unionByName(ledger, allowMissingColumns=True)
    return out
