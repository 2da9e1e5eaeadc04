"""Places in a global order without a window over all rows.

Rows are dealt by ranges of the order (bounds sampled by Spark, so near-equal values are
spread like any others) and written to the shared folder, which fixes the ranges. What is
gathered is one row for each range; every window lies within one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsight.sources.shared import shared_path


def with_places(df: DataFrame, order: Sequence[Column], sums: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``_place`` (from 1) and ``_rows`` (all), and for each of ``sums`` ``_upto_<column>``,
    its running total up to the row, the row included, and ``_all_<column>``.

    ``order`` should tell rows apart; among equal ones the place is any of theirs.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, "places")
    dealt = df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(path)
    kept = spark.read.schema(dealt.schema).parquet(path)
    each = kept.groupBy("_range").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_s_{c}") for c in sums))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    every = Window.partitionBy()
    before = each.select(
        "_range",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(every).alias("_rows"),
        *(F.sum(f"_s_{c}").over(every).alias(f"_all_{c}") for c in sums),
        *(F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums),
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = kept.join(before, "_range").withColumns(
        {"_place": F.row_number().over(inside) + F.col("_before")}
        | {f"_upto_{c}": F.coalesce(F.sum(c).over(upto), F.lit(0)) + F.col(f"_before_{c}") for c in sums}
    )
    return placed.drop("_range", "_before", *(f"_before_{c}" for c in sums))


def ntile_of(place: Column, rows: Column, tiles: int) -> Column:
    """The tile, from 1, of a place among ``rows``: the first tiles are one row larger."""
    small, larger = F.floor(rows / tiles), rows % tiles
    head = larger * (small + 1)
    return (
        F.when(place <= head, F.floor((place - 1) / (small + 1)))
        .otherwise(larger + F.floor((place - 1 - head) / F.greatest(small, F.lit(1))))
        .cast("int")
        + 1
    )
