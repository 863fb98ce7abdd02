"""Row numbers without a sort of all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import staged


def with_offsets(parts: DataFrame, part: str, n: str) -> DataFrame:
    """How many rows lie in the parts before each one. One row for each part comes in, so there are as many as partitions, not as rows."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias("offset"))


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df, of distinct rows, numbered from 0 in the given order: sorted by ranges, numbered within them, shifted by the ranges before."""
    ranges = staged(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    offsets = with_offsets(ranges.groupBy("__range").count(), "__range", "count")
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranges.withColumn("__inside", inside).join(offsets, "__range").withColumn(name, (F.col("__inside") - 1 + F.col("offset")).cast("long")).drop("__range", "__inside", "offset")
