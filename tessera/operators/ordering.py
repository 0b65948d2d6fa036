"""Dense ordinals without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.work import work_table


def with_ordinal(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with the 0-based rank of each row by the columns `order`: rows are dealt to ranges and
    sorted in each; a range's rows come after all of the ranges before it."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = work_table(dealt.withColumn("_at", F.monotonically_increasing_id()), "ordinal")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = dealt.groupBy(part.alias("_part")).count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    placed = dealt.withColumn("_part", part).join(F.broadcast(starts), "_part")  # a row a range
    return placed.withColumn(name, F.col("_start") + place).drop("_part", "_start", "_at")


def first_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in an order: each task keeps n at most."""
    return df.orderBy(*order).limit(n)
