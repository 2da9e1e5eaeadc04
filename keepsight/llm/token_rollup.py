"""Token totals kept up by signed deltas, committed once for each batch.

Totals by source, language and tokenizer version are sums, so a change of any kind is a
sum too: what a document counted before, with a minus, and what it counts now, with a
plus. A batch of changes is reduced to one delta a group, written aside and moved to the
batch's name in one rename, which fails if the name is taken: of two writers of a batch one
counts, a writer that dies leaves nothing that counts, and nothing rewrites what counts.
A snapshot holds the totals of the batches it names, so a reader adds only later deltas.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsight.llm.bpe import vocabulary
from keepsight.llm.storage import drop, listed, moved

GROUP = ["source", "lang", "tokenizer"]
_SIDE = "struct<source: string, lang: string, tokenizer: string, tokens: bigint>"


def side(source, lang, tokenizer, tokens):
    """What one document counts under one tokenizer version: a side of a change."""
    return F.struct(
        F.col(source).alias("source") if isinstance(source, str) else source.alias("source"),
        F.col(lang).alias("lang") if isinstance(lang, str) else lang.alias("lang"),
        tokenizer.alias("tokenizer"),
        tokens.cast("bigint").alias("tokens"),
    )


def signed(changes: DataFrame, times: str | None = None) -> DataFrame:
    """``source, lang, tokenizer, n_docs, n_tokens`` that ``changes`` add to the totals.

    A change has the structs ``before`` and ``after``: an insert has no ``before``, a delete
    no ``after``, a revised count or a move to another group has both. Sums are taken in
    every task before the shuffle, so a hot group costs one row a task. Null sources and
    languages are groups of their own; null tokens count as none; repeated rows count each.
    ``times`` names a column that says how often a change is made (null: never).
    """
    halves = F.array(
        F.struct(F.lit(-1).alias("sign"), F.col("before").cast(_SIDE).alias("x")),
        F.struct(F.lit(1).alias("sign"), F.col("after").cast(_SIDE).alias("x")),
    )
    often = F.lit(1) if times is None else F.coalesce(F.col(times), F.lit(0))
    rows = changes.select(F.explode(halves).alias("h"), often.cast("bigint").alias("often"))
    rows = rows.filter("h.x IS NOT NULL").select((F.col("h.sign") * F.col("often")).alias("sign"), "h.x.*")
    return rows.groupBy(*GROUP).agg(
        F.sum("sign").cast("bigint").alias("n_docs"),
        F.coalesce(F.sum(F.col("sign") * F.col("tokens")), F.lit(0)).cast("bigint").alias("n_tokens"),
    )


class TokenLedger:
    """Batches of deltas and snapshots of totals under ``root``, a folder that driver and executors share.

    After every ``compact_every`` batches a commit writes a snapshot of the totals.
    """

    _DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"

    def __init__(self, spark: SparkSession, root: str, compact_every: int = 16):
        self.spark, self.root, self.compact_every = spark, root.rstrip("/"), compact_every

    def batches(self) -> set[str]:
        """Names of the batches that count."""
        return {name.removeprefix("batch=") for name in listed(self.spark, f"{self.root}/deltas")}

    def committed(self, batch: str) -> bool:
        return batch in self.batches()

    def _put(self, rows: DataFrame, place: str) -> bool:
        """Write ``rows`` aside and move them to ``place``; false, and nothing left, if that is taken."""
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(staged)
        if moved(self.spark, staged, f"{self.root}/{place}"):
            return True
        drop(self.spark, staged)
        return False

    def commit(self, batch: str, changes: DataFrame, times: str | None = None) -> bool:
        """Apply ``changes`` once under the name ``batch``; false if it was applied before."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch is named by letters, digits, - and _")
        if self.committed(batch) or not self._put(signed(changes, times), f"deltas/batch={batch}"):
            return False
        if len(self.batches() - self._snapshot()[1]) >= self.compact_every:
            self.compact()
        return True

    def _snapshot(self) -> tuple[str | None, set[str]]:
        """The latest snapshot's place, and the batches it holds."""
        found = sorted(listed(self.spark, f"{self.root}/snapshots"))
        if not found:
            return None, set()
        path = f"{self.root}/snapshots/{found[-1]}"
        names = self.spark.read.schema("batch string").parquet(path).filter("batch IS NOT NULL").select("batch")
        return path, {r["batch"] for r in names.collect()}

    def _sums(self) -> tuple[DataFrame, set[str]]:
        path, held = self._snapshot()
        now = self.batches()
        later = [f"{self.root}/deltas/batch={name}" for name in sorted(now - held)]
        read = self.spark.read.schema(self._DELTA)
        rows = self.spark.createDataFrame([], self._DELTA)
        if path:
            rows = rows.unionAll(self.spark.read.schema(f"{self._DELTA}, batch string").parquet(path).filter("batch IS NULL").drop("batch"))
        if later:
            rows = rows.unionAll(read.option("recursiveFileLookup", True).parquet(*later))
        sums = rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 OR n_tokens <> 0"), now | held

    def compact(self) -> None:
        """Write the totals of all batches that count now, with those batches' names.

        Of two snapshots of as many batches the first stays; each is right by itself.
        """
        sums, names = self._sums()
        rows = self.spark.createDataFrame([(name,) for name in sorted(names)], "batch string")
        self._put(sums.unionByName(rows, allowMissingColumns=True), f"snapshots/n={len(names):012d}")

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens``: the latest snapshot and the deltas after it.

        Groups in which nothing is left are not listed. No commit gives no rows.
        """
        return self._sums()[0]


def token_counts(docs: DataFrame, vocabularies: dict[str, str], text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``counts``: tokens of the whole text by tokenizer version.

    ``vocabularies`` gives each version's file of ranks. A null or empty text has none. A
    column named ``counts`` is replaced.
    """
    columns = [c for c in docs.columns if c not in (text_col, "counts")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpes = {name: vocabulary(path) for name, path in vocabularies.items()}
        for batch in batches:
            found = []
            for text in batch.column(batch.num_columns - 1):
                text = text.as_py() or ""
                found.append([(name, len(bpe.ids(text))) for name, bpe in bpes.items()])
            kind = pa.map_(pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], [*columns, "counts"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns)
    return docs.select(*columns, text_col).mapInArrow(count, f"{schema}, counts map<string, bigint>")
