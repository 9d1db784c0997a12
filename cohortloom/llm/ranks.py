"""Places of rows in a global order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch


def ranked(table: DataFrame, group: list[str], order: list[Column], scratch: Scratch) -> DataFrame:
    """``table``, written in order, with ``rank`` (from 0) and ``total`` of its ``group``; a null group is one too.

    Rows are range-partitioned by group and order and numbered where they lie;
    only the counts of each group in each partition meet, a table as long as
    the partitions and groups together. ``table`` is read twice (the bounds of
    the ranges come from a sample), so it should be narrow and written. Rows
    that ``order`` cannot tell apart get ranks of their own.
    """
    by = [F.col(c) for c in group] + order
    placed = scratch.keep(table.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_row", 33))
    counts = placed.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    keys = [F.col(c) for c in group] or [F.lit(0)]
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_part").alias("_in"), "_first", (F.sum("_n").over(before) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("total"))
    same = F.col("_part") == F.col("_in")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = placed.join(starts, same)
    return out.select(*table.columns, (F.col("_row") - F.col("_first") + F.col("_before")).alias("rank"), "total")
