"""Repeated runs of lines, found with a suffix array over sequences of line ids.

Every document is a sequence of line ids. Prefix doubling ranks its suffixes: ranks by
the first line, then by pairs of ranks one, two, four ... lines apart, each round one
global ordering of the distinct pairs. A suffix told apart from all others leaves the
rounds, so their work is that of the repeated lines only. Suffixes that agree on their
first lines are one interval of the array, with a common prefix at least that long. For
every suffix the shortest prefix of ``min_words`` words is looked up; each interval's
first place is kept and the others are later copies. Their union over all suffixes is
what the later copies of the maximal repeated runs cover.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsight.llm.order import ranked
from keepsight.llm.storage import Scratch

BLANK = " \t\n\x0b\f\r"
_DOC = ["doc", "body"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with what tells a document apart: its id (null before all) and its text's hash."""
    least = F.lit(-(1 << 63)).cast("bigint")
    return docs.withColumns({"doc": F.coalesce(F.col(id_col).cast("bigint"), least), "body": F.xxhash64(text_col)})


def line_sequences(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """``doc, body, pos, line_no, h1, h2, words, need`` of every line that has a word.

    ``pos`` counts such lines; two 64-bit hashes are the id of the line without the white
    space around it; ``need`` is how many lines from here make ``min_words`` words, null if
    the document ends before.
    """
    stripped = F.transform(F.split(text_col, "\n"), lambda x, i: F.struct(i.alias("line_no"), F.btrim(x, F.lit(BLANK)).alias("line")))
    lines = F.posexplode(F.filter(stripped, lambda x: x["line"] != ""))
    rows = _keyed(docs, id_col, text_col).select(*_DOC, lines.alias("pos", "at"))
    line = F.col("at.line")
    rows = rows.select(
        *_DOC,
        "pos",
        "at.line_no",
        F.xxhash64(line).alias("h1"),
        F.xxhash64(F.lit(7), line).alias("h2"),
        F.size(F.split(line, "[ \t-\r]+")).cast("bigint").alias("words"),
    ).dropDuplicates([*_DOC, "pos"])
    w = Window.partitionBy(*_DOC)
    rows = rows.withColumns(
        {
            "_before": F.sum("words").over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"),
            "_total": F.sum("words").over(w),
        }
    )
    need = F.count("*").over(w.orderBy("_before").rangeBetween(0, min_words - 1))
    enough = F.col("_total") - F.col("_before") >= min_words
    return rows.withColumn("need", F.when(enough, need).cast("int")).drop("_before", "_total")


def _named(rows: DataFrame, by: list[str], scratch: Scratch) -> DataFrame:
    """``doc, body, pos, rank`` of the rows whose ``by`` columns others have too.

    Ranks follow the order of ``by``: a place in the ordering of the distinct values.
    """
    shared = rows.groupBy(*by).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return scratch.write(rows.join(ranked(shared, by, scratch), by).select(*_DOC, "pos", "rank"), "level")


def repeated_runs(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc, body, pos, need, first``: every later copy of a run of ``need`` lines from ``pos``.

    ``first`` is the run's earliest place by (document, position). A copy that overlaps the
    first place within one document is not a later copy, so the first stays whole.
    """
    longest = lines.agg(F.max("need")).first()[0] or 0
    level = _named(lines, ["h1", "h2"], scratch)
    width, found = 1, None
    while width <= longest:
        head = level.select(*_DOC, "pos", F.col("rank").alias("n1"))
        tail = level.select(*_DOC, F.col("pos").alias("_end"), F.col("rank").alias("n2"))
        runs = (
            lines.filter(F.col("need").between(width, 2 * width - 1))
            .select(*_DOC, "pos", "need", (F.col("pos") + F.col("need") - width).alias("_end"))
            .join(head, [*_DOC, "pos"])
            .join(tail, [*_DOC, "_end"])
            .drop("_end")
        )
        found = runs if found is None else found.union(runs)
        if 2 * width <= longest:
            ahead = tail.withColumn("pos", F.col("_end") - width).drop("_end")
            level = _named(head.join(ahead, [*_DOC, "pos"]), ["n1", "n2"], scratch)
        width *= 2
    if found is None:
        found = level.select(*_DOC, "pos", F.lit(0).alias("need"), F.col("rank").alias("n1"), F.col("rank").alias("n2"))
    found = scratch.write(found, "runs")
    key = ["need", "n1", "n2"]
    firsts = found.groupBy(*key).agg(F.min(F.struct("doc", "pos", "body")).alias("first"), F.count("*").alias("_n"))
    copies = found.join(firsts.filter("_n > 1").drop("_n"), key)
    same = (F.col("doc") == F.col("first.doc")) & (F.col("body") == F.col("first.body"))
    later = F.when(same, F.col("pos") >= F.col("first.pos") + F.col("need")).otherwise(True)
    return copies.filter(later).select(*_DOC, "pos", "need", "first")


def deleted_lines(
    docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc, body, lines, words, sources`` of every document that loses lines.

    ``lines`` are the numbers of its deleted lines in the text as split by newline, ``words``
    their words, ``sources`` the ids of the documents that hold the first copies.
    """
    scratch = Scratch("lineruns")
    lines = scratch.write(line_sequences(docs.select(id_col, text_col), min_words, id_col, text_col), "lines")
    runs = repeated_runs(lines, scratch)
    covered = runs.select(
        *_DOC, F.explode(F.expr("sequence(pos, pos + need - 1)")).alias("pos"), F.col("first.doc").alias("source")
    )
    covered = covered.groupBy(*_DOC, "pos").agg(F.min("source").alias("source"))
    hit = lines.join(covered, [*_DOC, "pos"])
    return hit.groupBy(*_DOC).agg(
        F.sort_array(F.collect_list("line_no")).alias("lines"),
        F.sum("words").alias("words"),
        F.sort_array(F.collect_set("source")).alias("sources"),
    )


def line_report(
    docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, deleted_lines, n_deleted_words, copied_from`` of every row of ``docs``.

    Only runs of whole lines count, of at least ``min_words`` words together. Documents are
    ordered by id, a missing id first; rows of equal id and text are one document and share
    their result. A null or blank text has no line and loses none; the arrays are then empty.
    Blank lines belong to no run. Other columns are not read.
    """
    gone = deleted_lines(docs, min_words, id_col, text_col)
    rows = _keyed(docs.select(id_col, text_col), id_col, text_col).select(F.col(id_col).alias("doc_id"), *_DOC)
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return rows.join(gone, _DOC, "left").select(
        "doc_id",
        empty("lines", "array<int>").alias("deleted_lines"),
        F.coalesce("words", F.lit(0).cast("bigint")).alias("n_deleted_words"),
        empty("sources", "array<bigint>").alias("copied_from"),
    )


def without_copied_lines(
    docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = True
) -> DataFrame:
    """``docs`` with the lines of later copies taken out of their texts.

    A document of which nothing but white space is left goes, unless ``drop_emptied`` is
    false; one that was blank before stays. All other columns stay as they are.
    """
    gone = deleted_lines(docs, min_words, id_col, text_col).select(*_DOC, F.col("lines").alias("_gone"))
    columns = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
    ident, text = f"c{columns.index(id_col)}", f"c{columns.index(text_col)}"
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    joined = _keyed(plain, ident, text).join(gone, _DOC, "left")
    joined = joined.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(left))
    if drop_emptied:
        joined = joined.filter(F.col("_gone").isNull() | (F.btrim(text, F.lit(BLANK)) != ""))
    return joined.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)])
