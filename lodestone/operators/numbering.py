"""Row numbers in an order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.staging import staged


def numbered(rows: DataFrame, order: list[tuple[Column, bool]], name: str) -> DataFrame:
    """[R1, R9] order: (column, ascending); nulls are smallest. rows with ``name`` (long), from 0 in the given order: dealt to
    ranges of the order, numbered within each, shifted by the rows in the ranges
    before. One number for each range is summed in one task, not the rows. rows' columns may have any names."""
    columns = rows.columns
    packed = rows.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), *(c.alias(f"key{k}") for k, (c, _) in enumerate(order)))
    by = [F.col(f"key{k}").asc() if up else F.col(f"key{k}").desc() for k, (_, up) in enumerate(order)]
    ranges = staged(packed.repartitionByRange(*by).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*by))
    return ranges.withColumn("inside", inside).join(offsets, "range").select(*(F.col("row")[c].alias(c) for c in columns), (F.col("inside") - 1 + F.col("offset")).cast("long").alias(name))
