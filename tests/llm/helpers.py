from __future__ import annotations

from pyspark.sql import functions as F

from tests.conftest import SF_DIR

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def docs_of(spark, texts, **more):
    """A documents table with these texts, numbered from 0."""
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_docs(spark):
    """Nulls in every column, blank and long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"word{k % 977} part{k % 31}." for k in range(20_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4),
        (4, long, "en", "s", len(long)), (4, long, "en", "s", len(long)),
        (None, "no id here but a few words", "en", None, 26), (None, None, None, None, None),
        (5, "one", "en", "s", 3), (6, "two words", "fr", "s", 9), (6, "other words", "fr", "s", 11),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    clash = ["rank", "node", "id", "key", "size", "quality", "measures", "kept", "doc", "body", "words", "label", "seeds"]
    return docs.withColumns({c: F.lit("x") for c in clash})


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
