"""A user function per row, where one bad row does not stop the others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def map_with_errors(
    df: DataFrame, fn: Callable[[dict], object], value_type: str | T.DataType, ordinal: str
) -> DataFrame:
    """``(ordinal, success, value, error)``: ``fn`` applied to each row as a dict.

    An exception becomes the row's ``error``, and so does a result that is not of
    ``value_type``. Values reach ``fn`` as they are: whole numbers stay whole and a
    null is None, whatever else the batch holds. Rows stream through Arrow batches;
    parallelism is the number of partitions. ``ordinal`` names a column of ``df``
    that says which row a result belongs to.
    """
    value = value_type if isinstance(value_type, T.DataType) else T.DataType.fromDDL(value_type)
    schema = T.StructType(
        [
            T.StructField(ordinal, df.schema[ordinal].dataType),
            T.StructField("success", T.BooleanType()),
            T.StructField("value", value),
            T.StructField("error", T.StringType()),
        ]
    )
    kind = to_arrow_type(value)

    def single(value: object) -> tuple[pa.Array, str | None]:
        try:
            return pa.array([value], kind), None
        except Exception as problem:  # noqa: BLE001
            return pa.nulls(1, kind), str(problem)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, errors = [], []
            for row in batch.to_pylist():
                try:
                    values.append(fn(row))
                    errors.append(None)
                except Exception as problem:  # noqa: BLE001 - isolating failures is the point
                    values.append(None)
                    errors.append(str(problem))
            try:
                column = pa.array(values, kind)
            except Exception:  # noqa: BLE001 - some result is not of the type: find which
                parts, wrong = zip(*map(single, values))
                column = pa.concat_arrays(parts)
                errors = [e if e is not None else w for e, w in zip(errors, wrong)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(ordinal),
                    pa.array([e is None for e in errors], pa.bool_()),
                    column,
                    pa.array(errors, pa.string()),
                ],
                [ordinal, "success", "value", "error"],
            )

    return df.mapInArrow(run, schema)
