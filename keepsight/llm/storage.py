"""Intermediate tables in the shared folder, which cut lineage and outlive executors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from keepsight.sources.shared import shared_path


class Scratch:
    """The tables one run of an operator writes; those it has used up can be dropped."""

    def __init__(self, name: str):
        self.name = name

    def write(self, df: DataFrame, table: str) -> DataFrame:
        """The rows of ``df``, written once and read back."""
        return self.located(df, table)[0]

    def located(self, df: DataFrame, table: str) -> tuple[DataFrame, str]:
        path = shared_path(df.sparkSession, f"{self.name}-{table}")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark, path: str) -> None:
    """Remove a table nothing reads any more, in whatever file system it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def listed(spark, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(target)] if files.exists(target) else []


def moved(spark, source: str, target: str) -> bool:
    """Rename ``source`` to ``target`` at once; false if ``target`` exists."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs
    old, new = fs.Path(source), fs.Path(target)
    files = new.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(new.getParent())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(old), files.makeQualified(new), options)
    except Exception:
        if files.exists(old) and files.exists(new):
            return False
        raise
    return True
